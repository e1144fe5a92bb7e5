"""Single JSON documents (settings): read, changed, and written with the version before kept beside them."""

from __future__ import annotations

import json

from pyarrow import fs

from skein.sources.transcripts import opened

#: The flag that hangs a resumed session on some systems. Fixed value.
TRUST_FLAG = "hasTrustDialogAccepted"


def read(path: str) -> dict | None:
    """The object in a file; {} if there is no file, None if it can't be read as an object."""
    system, place = opened(path)
    if system.get_file_info(place).type == fs.FileType.NotFound:
        return {}
    try:
        with system.open_input_stream(place) as file:
            value = json.loads(file.read().decode("utf-8"))
    except (ValueError, OSError):
        return None
    return value if isinstance(value, dict) else None


def write(path: str, value: dict) -> str | None:
    """Writes an object; the file before, if any, is copied to the same name with .bak, which is given back."""
    system, place = opened(path)
    backup = None
    if system.get_file_info(place).type != fs.FileType.NotFound:
        backup = f"{place}.bak"
        system.copy_file(place, backup)
    else:
        system.create_dir(place.rpartition("/")[0], recursive=True)
    with system.open_output_stream(place) as file:
        file.write((json.dumps(value, indent=2) + "\n").encode())
    return backup


def flagged(value: dict) -> list[str]:
    """Where the trust flag is set: `top-level`, or the key of an object that has it."""
    places = ["top-level"] if value.get(TRUST_FLAG) is True else []
    return places + [k[:60] for k, v in value.items() if isinstance(v, dict) and v.get(TRUST_FLAG) is True]


def unflagged(value: dict) -> dict:
    """A copy with the flag reset wherever it is set."""
    reset = lambda v: {**v, TRUST_FLAG: False} if v.get(TRUST_FLAG) is True else v
    return reset({k: reset(v) if isinstance(v, dict) else v for k, v in value.items()})


def with_hooks(settings: dict, wanted: dict[str, list[dict]]) -> tuple[dict, list[str]]:
    """Settings with the hooks that they lack, and the names of those added: an event has one of ours for each matcher.

    Ours are the hooks whose command begins like one of the wanted ones; running it again adds nothing.
    """
    ours = {h["command"].split()[0] for entries in wanted.values() for e in entries for h in e["hooks"]}
    hooks = {event: list(entries) for event, entries in settings.get("hooks", {}).items()}
    added = []
    for event, entries in wanted.items():
        held = hooks.setdefault(event, [])
        known = {e.get("matcher", "") for e in held if any(h.get("command", "").split()[:1] and h["command"].split()[0] in ours for h in e.get("hooks", []))}
        for entry in entries:
            if entry.get("matcher", "") not in known:
                held.append(entry)
                added.append(f"{event}[{entry.get('matcher', '')}]")
    return {**settings, "hooks": hooks}, added
