"""Where credentials stand in code, settings and commands, and what their values look like.

Everything here works on one text at a time. Text may be stored as is or inside a JSON string, so
a quote may have a backslash before it and a line may end with the two characters backslash and n.
"""

from __future__ import annotations

import base64
import bisect
import math
import re
from collections import Counter

# Last words of a name that holds a credential, and words that make `key` one.
SECRET_WORDS = "password|passwd|passphrase|passcode|pwd|pass|secret|token|credentials|credential"
KEY_WORDS = "api|access|signing|sign|secret|private|auth|encryption|encrypt|master|tls|ssl|ssh|session|service|account|license|deploy|hmac|jwt|webhook|storage|shared"

Q = r"\\?[\"'`]"
QUOTED = r"(?P<q>\\?[\"'`])(?P<v>(?:(?!(?P=q))[^\n\\])*)(?P=q)"
BARE = r"(?P<v>[^\s\"'`,;<>(){}\[\]\\|&]{4,}+)(?![(\[{])"
#: a word that may end the name of a credential; what stands before it is looked at only then
WORD = re.compile(rf"(?i:{SECRET_WORDS}|key)(?![A-Za-z0-9_\-])")
_KEY_BEFORE = re.compile(rf"(?:(?<![A-Za-z])(?i:{KEY_WORDS})[_\-]?|(?:{'|'.join(w.title() for w in KEY_WORDS.split('|'))}))$")
_NAME_BEFORE = re.compile(r"[A-Za-z0-9_.\-]*$")

# What follows the name, each with what must stand before it.
_TAILS = [
    # ?name=value&
    (r"[?&]$", r"=(?P<v>[^\s&\"'`\\#<>]+)"),
    # --name value, --name=value
    (r"(?<![A-Za-z0-9])--?$", rf"[ =]+(?:{Q})?(?P<v>[^\s\"'`\\]+)"),
    # <name>value</name>
    (r"<$", r"\s*>\s*(?P<v>[^<>\s\\]+)\s*</"),
    # name = "value", "name" : "value", config["name"] = "value", NAME = ("value"
    (r"", rf"(?:{Q})?\s*\]?\s*(?::=|=>|[:=])\s*\(?\s*[bfru]?{QUOTED}"),
    # password: str = "value"
    (r"", rf"\s*:\s*[A-Za-z]+\s*=\s*{QUOTED}"),
    # name: value, NAME=value
    (r"", rf"\s*[:=]\s*{BARE}"),
    # set("X-Name", "value")
    (rf"{Q}$", rf"{Q}\s*,\s*{QUOTED}"),
    # - name: NAME / value: "value"
    (rf"name(?:{Q})?\s*:\s*(?:{Q})?$", rf"(?:{Q})?\s*,?\s*(?:{Q})?value(?:{Q})?\s*:\s*{QUOTED}"),
    (rf"name\s*:\s*(?:{Q})?$", rf"(?:{Q})?\s*value\s*:\s*{BARE}"),
    # with password 'value'
    (r"(?i)\b(?:with|by|set|encrypted|and|using)\s+$", rf"\s+{QUOTED}"),
    # machine h login u password value
    (r"\blogin\s+\S+\s+$", r"\s+(?P<v>[^\s\"'`\\]+)"),
    # the password is value
    (r"(?i)", r"(?<=[dD])\s+(?:is|was)\s+(?P<v>[^\s\"'`\\,;]{6,})"),
]
TAILS = [(re.compile(before), re.compile(after)) for before, after in _TAILS]
# Places that need no name.
_PLACES = [
    # scheme://user:value@host
    ("address", r"://[^\s:/@\"'`\\]*:(?P<v>[^\s@/\"'`\\]+)@"),
    # curl -u user:value
    ("address", rf"(?<![A-Za-z0-9\-])(?:-u|--user)[ =](?:{Q})?[^\s:\"'`\\]+:(?P<v>[^\s\"'`\\]+)"),
    # Authorization: Bearer value
    ("header", rf"(?i:authorization)(?:{Q})?\s*[:=,]\s*(?:{Q})?(?i:bearer|basic|token)\s+(?P<v>[^\s\"'`\\,;]+)"),
    # identified by "value"
    ("spoken", rf"(?i:\bidentified\s+by)\s+{QUOTED}"),
    # login(user='u', 'value')
    ("spoken", rf"(?i:login|connect|auth|authenticate|signin)\(\s*(?:user(?:name)?\s*=\s*)?{Q}[^\"'`\\]*{Q}\s*,\s*{QUOTED}"),
    # uses value as login password
    ("spoken", r"\b(?i:uses?|using|with)\s+(?P<v>[^\s\"'`\\]{6,})\s+as\s+(?:\w+\s+){0,2}(?i:password|passphrase|secret|token|key)\b"),
]
PLACES = [(kind, re.compile(rule)) for kind, rule in _PLACES]
#: what joins the pieces of one string: "a" + "b", ("a" / "b"); a piece before a colon is the next key
MORE = re.compile(rf"{Q}\s*(?:[+.&]|\\)?\s*[bfru]?{QUOTED}(?!\s*[:=])")
# Literals and bare words that look like issued tokens, wherever they stand.
STRUCTURED = re.compile(r"(?<![A-Za-z0-9_\-+/=.@%#$&])(?P<v>[A-Za-z0-9][A-Za-z0-9_\-./+]{14,}={0,2})(?![A-Za-z0-9_\-+/=@])")
PRIVATE_KEY = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
PRIVATE_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
# Blocks that are public: nothing inside them is a secret. Without an END line before the next BEGIN, see _BODY.
PUBLIC = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*(?:PUBLIC KEY|CERTIFICATE)(?: [A-Z]+)*-----")
_MARK = re.compile(r"-----(BEGIN|END) [A-Z0-9 ]+-----")
PUBLIC_LINE = re.compile(r"(?:data:[\w/+.\-]+;base64,|sha(?:1|256|384|512)-|ssh-(?:rsa|ed25519|dss) )\S*")

_MASK = re.compile(r"^(.{0,4})(.)\2{4,}(?!.{5})|^\W*$|^<.*>?$|^\{.*|^\$.*|^%.*%?$|^\*+|\.\.\.|^[xX*#.\-_]+$|…")
# Words that make a value a placeholder wherever they are a word of it, and those that must stand apart in it.
_SURE = {"changeme", "changeit", "changethis", "example", "placeholder", "dummy", "sample", "redacted"}
_APART = {"your", "my", "replace", "insert", "enter", "todo", "fixme", "none", "null", "undefined", "true", "false", "test", "testing", "here", "change", "xxx"}
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_SPLIT = re.compile(r"[^A-Za-z0-9]+")
# Words of prompts and messages: a quoted text with one of them is no passphrase.
_PROMPT = set(
    "a an the your my our this that is are was be must should can cannot not no to of for in on at by with from and or if as please enter type insert give set use new old current valid invalid missing required wrong incorrect expired "
    "failed empty too short long here below above again change reset forgot do does did has have will may it you we they be been only optional error warning".split()
)
_REFERENCE = re.compile(r"(?i)^(?:\$|\{\{|%\{|#\{|<)|\{[a-z_.]+\}|^(?:env|vault|secret|secretsmanager|ssm|arn|ref|file|op|keyring|aws|gcp|kms)[:/.]|os\.environ|process\.env|getenv|^self\.|^[a-z_]+(?:\.[a-z_]+)+$")
# What is documented or guessed: words that fill shared defaults, and runs of digits and keys.
_STAND_IN = re.compile(
    r"default|shared|common|public|generic|standard|guest|admin(?:istrator)?|root|super|user(?:name)?|login|welcome|letmein|pass(?:word|wd|wort|phrase|code)?|secret|token|demo|local(?:host)?|devel(?:op|opment)?|staging|"
    r"postgres(?:ql)?|mysql|maria(?:db)?|mongo(?:db)?|redis|rabbit(?:mq)?|minio|elastic|grafana|oracle|tomcat|vagrant|docker|jenkins|test(?:ing)?|temp|hello|world|foo|bar|baz|qwert[yz]?|asdf(?:gh)?|master|iloveyou|monkey|dragon|abc\d*|"
    r"0?123\d*|6?54321\d*|(\d)\1{3,}"
)
_LEET = str.maketrans("@$0134", "asoiea")
_ESCAPE = re.compile(r"\\\\|\\[nrt]")
_KEY_BODY = re.compile(r"[A-Za-z0-9+/=]{16,}")
# The base64 lines that directly follow a header: quotes, joints and line numbers may stand between, and
# lines like `DEK-Info: ...`; the first has both cases and a digit or sign, the last of a text may be short.
_BETWEEN = r"(?:\\[nrt]|(?:Proc-Type|DEK-Info|Version|Comment|Hash): [^\n\\]*|\d{1,6}(?=[→:|\t])|[^A-Za-z0-9])*+"
_BODY = re.compile(rf"{_BETWEEN}(?=[A-Za-z0-9+/=]*[0-9+/])(?=[A-Za-z0-9+/=]*[a-z])(?=[A-Za-z0-9+/=]*[A-Z])[A-Za-z0-9+/=]{{16,}}+(?:{_BETWEEN}[A-Za-z0-9+/=]{{16,}}+)*+(?:{_BETWEEN}[A-Za-z0-9+/=]+\Z)?")
_UUID = re.compile(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")


def entropy(value: str) -> float:
    """Bits a character, from the value's own character counts."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def classes(value: str) -> int:
    """How many of lower case, upper case, digits and signs occur."""
    return sum(bool(re.search(p, value)) for p in (r"[a-z]", r"[A-Z]", r"\d", r"[^A-Za-z0-9]"))


def _passphrase(value: str) -> bool:
    """Several plain words, none of which a prompt or message would use."""
    words = value.split(" ")
    return len(words) >= 3 and all(re.fullmatch(r"[A-Za-z0-9\-']{2,}", w) for w in words) and not any(w.lower() in _PROMPT or re.fullmatch(rf"(?i){SECRET_WORDS}|key", w) for w in words)


def placeholder(value: str) -> bool:
    """Empty, masked, a stand-in or a reference, by its form alone.

    Words such as none or your count where they stand apart, not inside a random string; a value
    with blanks is a secret only if it is a passphrase.
    """
    if re.search(r"\s", value):
        return not _passphrase(value)
    if len(value) < 5 or re.fullmatch(r"[a-z]+|[A-Z]?[a-z]+|[A-Z]+|\d{1,5}", value) or _MASK.search(value) or _REFERENCE.search(value):
        return True
    low = value.lower()
    if _SURE & {w.lower() for w in _WORDS.findall(value)} or _SURE & {*_SPLIT.split(low), re.sub(r"[^a-z]", "", low)}:
        return True
    if structured(value):
        return False
    ends = _WORDS.findall(value)
    return bool(_APART & {*_SPLIT.split(low), *(w.lower() for w in ends[:1] + ends[-1:])})


def stand_in(value: str) -> bool:
    """A default or guess by its form: known words of such make up more than half of it, as is or in leet, and the rest isn't structured."""
    if structured(re.sub(_STAND_IN.pattern, "", value, flags=re.IGNORECASE)):
        return False
    if re.fullmatch(r"[A-Za-z0-9+/]{6,}={0,2}", value) and len(value) % 4 == 0:
        # user:password of a basic header
        pair = base64.b64decode(value)
        if b":" in pair and pair.isascii() and pair.decode().isprintable():
            value = pair.decode().partition(":")[2] or value
    low = value.lower()
    return any(2 * sum(len(m[0]) for m in _STAND_IN.finditer(form)) > len(value) for form in (low, low.translate(_LEET)))


def structured(value: str) -> bool:
    """A value that looks issued by a machine: long, mixed, without the shape of words or hashes."""
    if _UUID.match(value) or re.fullmatch(r"(?i)(?:0x)?[0-9a-f]+|sha\d+[-:].*", value):
        return False
    body = re.split(r"[/.]", value)
    if "/" in value and all(re.fullmatch(r"[a-z0-9_\-]*", p) for p in body):
        return False
    digits = len(re.findall(r"\d", value))
    turns = len(re.findall(r"[a-z][A-Z0-9]|[A-Z0-9][a-z]|[A-Z]\d|\d[A-Z]", value))
    return digits >= 1 and classes(value) >= 3 and turns >= len(value) / 5 and entropy(value) >= 3.5


def opened(text: str) -> str:
    """The text of a JSON string with its line ends and tabs real, every character in its old place."""
    return _ESCAPE.sub(lambda m: m[0] if m[0] == "\\\\" else " \n", text)


def _named(text: str, word: re.Match) -> bool:
    """Whether the word ends the name of a credential: at a word part's start, `key` with a reason."""
    at = word.start()
    if word[0].lower() == "key":
        return bool(_KEY_BEFORE.search(text, max(0, at - 12), at))
    before = text[at - 1] if at else " "
    return not before.isalpha() or (word[0][0].isupper() and before.islower())


class _Spans:
    """Parts of a text, joined where they meet; a place is looked up by bisection."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end in sorted(spans):
            self.add(start, end)

    def add(self, start: int, end: int) -> None:
        i, j = bisect.bisect_left(self.ends, start), bisect.bisect_right(self.starts, end)
        if i < j:
            start, end = min(start, self.starts[i]), max(end, self.ends[j - 1])
        self.starts[i:j], self.ends[i:j] = [start], [end]

    def __contains__(self, at: int) -> bool:
        i = bisect.bisect_right(self.starts, at) - 1
        return i >= 0 and at < self.ends[i]


def literals(text: str) -> list[tuple[int, str, str, int]]:
    """All candidate literals of a text: (start, value, kind, end), one per start.

    Kinds: key (a private key; the value is its whole block, or what is left of it), assigned, address, header and
    spoken (its surroundings say it is a credential), literal (only its form does). The value of
    a string in several pieces is what the pieces give together; `end` is that of the last piece.
    """
    found: dict[int, tuple[str, str, int]] = {}
    hidden = [m.span() for m in PUBLIC_LINE.finditer(text)]
    for m in PUBLIC.finditer(text):
        mark = _MARK.search(text, m.end())
        cut = _BODY.match(text, m.end(), mark.start() if mark else len(text))
        hidden.append((m.start(), mark.end() if mark and mark[1] == "END" else cut.end() if cut else m.end()))
    for m in PRIVATE_KEY.finditer(text):
        end, other = PRIVATE_END.search(text, m.end()), PRIVATE_KEY.search(text, m.end())
        if end and not (other and other.start() < end.start()):
            body, stop = _KEY_BODY.search(text, m.end(), end.start()), end.end()
        else:  # cut off: the key is its header and what directly follows
            body = _BODY.match(text, m.end(), other.start() if other else len(text))
            stop = body.end() if body else m.end()
        hidden.append((m.start() + 1, stop))
        if body:
            found[m.start()] = (text[m.start() : stop], "key", stop)
    covered = _Spans([*hidden, *((start, end) for start, (_, _, end) in found.items())])

    def add(m: re.Match, kind: str) -> bool:
        start, stop = m.span("v")
        if not m["v"] or start in covered:
            return False
        value = m["v"]
        if "q" in m.re.groupindex and m["q"]:
            while more := MORE.match(text, stop):
                value, stop = value + more["v"], more.end("v")
        found[start] = (value, kind, stop)
        covered.add(start, stop)
        return True

    for word in WORD.finditer(text):
        if not _named(text, word):
            continue
        name = _NAME_BEFORE.search(text, max(0, word.start() - 80), word.start()).start()
        first = text[name : word.start()]
        dashes = len(first) - len(first.lstrip("-"))
        for before, after in TAILS:
            if (m := after.match(text, word.end())) and before.search(text, max(0, name - 60), name + dashes) and add(m, "assigned"):
                break
    for kind, rule in PLACES:
        for m in rule.finditer(text):
            add(m, kind)
    for m in STRUCTURED.finditer(text):
        if structured(m["v"]):
            add(m, "literal")
    return [(start, *rest) for start, rest in sorted(found.items())]
