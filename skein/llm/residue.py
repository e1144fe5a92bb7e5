"""Template residue, filler and error-page text among documents.

Messages that a site or a program writes are made from few templates, speech is not. The text is
read once: every sentence that says what messages say goes to a leaf of a prefix tree of
fixed depth (number of words, first words, last word; numbers masked). In a leaf there is a template
for every way its sentences agree: a word stays if other documents have it in the same place or if
it belongs to the vocabulary, so a sentence can never erase what another one says; a sentence that
would lose more than a third of its words is a template of its own. Templates, not documents, are
then classified, once each, and the verdict goes back to every document that has a sentence of theirs.

What the vocabulary doesn't know is judged by spread: a sentence found almost only on pages of
messages, beside several different ones, is one of them. Unresolved slots and filler can stand
anywhere inside ordinary text and are looked for separately, in the whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.session import cut

#: First words that lead to a leaf of the tree.
DEPTH = 3
#: Documents that must have a word in its place to keep it in a template.
LEAST_SUPPORT = 2
#: A sentence that would lose a larger share of its words is a template of its own.
MOST_VARIABLE = 0.3
#: A sentence is a message by spread if it stands beside so many different messages ...
LEAST_BESIDE = 3
#: ... and at least this share of its documents are pages of messages.
LEAST_SPREAD = 0.9
ANY = "<*>"

# ---- Fixed values: what messages are about, and what they say of it, in four languages.
_THING = (
    r"pages?|documents?|transcripts?|records?|sites?|websites?|web|servers?|sessions?|requests?|address|connection|database|service|files?|urls?|links?|reports?|sitting|contents?|resources?|gateway|articles?|"
    r"images?|videos?|forms?|comments?|applications?|app|items?|results?|data|feed|archive|host|network|login|account|"
    r"seite|webseite|dokument|protokoll|sitzungsbericht|bericht|inhalt|inhalte|datei|dienst|sitzung|verbindung|anfrage|server|datenbank|ressource|adresse|anwendung|artikel|verweis|konto|video|formular|kommentare?|"
    r"página|pagina|documento|diario|acta|archivo|contenido|servicio|servidor|sesión|enlace|solicitud|recurso|conexión|dirección|sitio|artículo|cuenta|"
    r"compte rendu|contenu|serveur|fichier|lien|adresse|accès|ressource|connexion|requête|site|base de données|compte|acceso|access|zugriff"
)
_NOT = r"(?:could|can|may|does|did|do|is|are|was|were|has|have)(?: ?not|n[’']t)|cannot|unable to|fail(?:ed|s|ure) to|not"
_DONE = (
    r"found|loaded|displayed|opened|rendered|shown|retrieved|reached|processed|completed|accessed|located|fetched|established|resolved|saved|played|sent|submitted|verified|parsed|read|written|started|"
    r"load|display|open|render|show|retrieve|reach|process|complete|access|locate|find|fetch|connect|available|exist|respond(?:ing)?|accessible|authori[sz]ed|allowed|permitted"
)
_FAILS = (
    rf"(?:{_NOT}) (?:be |been |currently |yet |to be |longer )?(?:{_DONE})|no longer (?:available|exists?|online)|(?:has|have) (?:expired|crashed)|expired|unexpected error|no results? found|too busy|(?:sign|log) in to continue|corrupt(?:ed)?|^(?:error|erreur|fehler) (?:<status>|<\*>)|"
    r"(?:has been|have been|was|were) (?:moved|deleted|removed|archived|suspended|blocked|disabled|locked|terminated)(?: or (?:moved|deleted|removed|renamed))?|(?:is|are) being (?:migrated|moved|updated)|connection (?:failed|lost|refused|reset|closed)|timed? ?out|"
    r"access (?:is )?(?:denied|forbidden|restricted)|permission to (?:view|access|open)|temporarily (?:down|offline|out of service)|(?:temporarily |currently )?unavailable|went wrong|too many (?:requests|redirects)|bad (?:gateway|request)|no valid reply|"
    r"(?:internal |server |fatal |system )?error (?:has )?(?:occurred|happened)|internal (?:server )?error|forbidden|unauthori[sz]ed|(?:under|for|down for|due to) (?:scheduled )?maintenance|broken link|moved permanently|"
    r"nicht (?:gefunden|geladen|verfügbar|mehr verfügbar|erreichbar|angezeigt|geöffnet|vorhanden|dargestellt|verarbeitet|abgerufen|abgespielt|gespeichert|mehr vorhanden)|existiert nicht|beschädigt|gesperrt|abgelaufen|(?:verschoben|gelöscht|entfernt)(?: oder (?:verschoben|gelöscht|entfernt))?|"
    r"wird (?:gerade |derzeit )?(?:migriert|gewartet)|(?:zugriff|zugang) (?:wurde )?verweigert|interner (?:server)?fehler|vorübergehend nicht|fehlgeschlagen|schiefgelaufen|zeitüberschreitung|fehler (?:ist )?aufgetreten|wartungsarbeiten|"
    r"introuvables?|est (?:rompue?|corrompue?|suspendue?|bloquée?)|n[’'](?:est|a) (?:plus|pas) (?:été )?(?:disponible|accessible|trouvée?|chargée?)|n[’']a pas pu|n[’']existe (?:pas|plus)|a expiré|accès (?:refusé|interdit)|a été (?:déplacée?|supprimée?|archivée?)|en cours de (?:migration|maintenance)|en maintenance|"
    r"erreur interne|indisponible|impossible (?:de |d[’'])(?:charger|afficher|trouver|ouvrir|accéder)|erreur (?:inattendue )?(?:s[’']est produite|est survenue)|délai (?:d[’']attente )?dépassé|"
    r"no (?:se )?(?:ha|han) podido|no (?:se )?pud(?:o|ieron)|no se (?:pudo|puede|encontró|encuentra|ha encontrado)|no existe|no encontrad[oa]|ya no (?:está disponible|existe)|no (?:está )?disponible|ha (?:caducado|expirado)|acceso (?:denegado|prohibido)|se ha perdido|ha sido (?:suspendid|bloquead)[oa]|"
    r"error (?:interno|inesperado)|se está migrando|ha sido (?:movid|eliminad)[oa]|tiempo de espera (?:agotado|excedido)|en mantenimiento|(?:ha ocurrido|se ha producido) un error"
)
# Of these nobody speaks but programs: one word beside them may be unknown.
_FIRM = (
    r"(?:could not|cannot|can[’']t|couldn[’']t|unable to|failed to) (?:be )?(?:loaded|load|displayed|display|rendered|render|opened|open|retrieved|retrieve|fetched|fetch)|too many requests|bad gateway|internal server error|error (?:has )?occurred|went wrong|"
    r"nicht (?:geladen|angezeigt|geöffnet|abgerufen) werden|(?:pu|impossible de) (?:être )?(?:chargée?|charger|affichée?|afficher)|(?:pudo|podido) (?:cargar|cargarse|mostrar|mostrarse|abrir)"
)
_SCRIPTS = r"java ?script|scripts?|cookies?|browser|navigateur|navegador|plug-?ins?|flash|ad ?blockers?|werbeblocker"
_DEMANDS = (
    r"enable|activate|allow|accept|turn (?:it|them|on|off)|needs?|requires?|required|blocked|disabled?|not supported|unsupported|switch on|update|upgrade|outdated|aktivieren|aktiviere|einschalten|erlauben|akzeptieren|benötigt|erforderlich|deaktiviert|deaktivieren|"
    r"activez|activer|autorisez|acceptez|nécessite|requis|désactivé|active|activa|habilite|habilita|permita|acepte|necesita|requiere|desactivado"
)
_NAVIGATION = (
    r"^(?:home|start|accueil|inicio|startseite)(?: ?[|>»/·] ?\S+){1,12}$|^(?:menu|imprint|search|sitemap|impressum|suche|recherche|buscar)[.:]?$|contact the (?:webmaster|administrator|site owner)|(?:return|back|go back) to (?:the )?(?:start|home|main|front|search)[ -]?(?:page|form)|"
    r"zurück zur (?:startseite|suche)|retour à (?:l[’']accueil|la recherche)|volver al (?:inicio|buscador)|(?:please )?log in again|veuillez vous (?:identifier|reconnecter)|(?:retry|try again) in <\*> (?:seconds|minutes)"
)
_PROGRAM = r"^https? <status>$|^traceback\b|\b(?:[a-z]+\.){1,8}[a-z]*(?:exception|error)\b|\b(?:key|type|value|attribute|index|name|null ?pointer|runtime|io|syntax|import|assertion)(?:error|exception)\b|^timeout after|^(?:fatal|warning|uncaught): "
# Words of a message besides what it is about and what it says of it: determiners, pronouns, prepositions, auxiliaries,
# and the courtesies of programs.
_BESIDE = (
    r"the|this|that|these|those|it|there|here|we(?:[’'](?:re|ve))?|i|you|your|our|us|a|an|any|some|something|is|are|was|were|be|been|being|do|does|did|has|have|had|having|can|could|may|might|will|would|at|on|of|off|from|to|for|with|while|when|if|as|and|or|but|in|into|by|due|after|before|no|not|never|yet|"
    r"currently|right now|now|please|sorry|apologi[sz]e|oops|error|http|occurred|encountered|experienced|experiencing|trouble|problems?|issues?|unexpected|requested|request|asked|looking|trying|loading|processing|view|sent|upstream|reply|try|again|later|soon|back|code|reload|refresh|message|status|line|ms|seconds?|minutes?|retry|"
    r"d(?:er|ie|as|en|em|es)|dies(?:er|e|es|en|em)?|ein(?:e|er|es|en|em)?|kein(?:e|er|es|en|em)?|unser(?:e|er|es|en|em)?|ihr(?:e|er|es|en|em)?|wir|sie|es|uns|angeforderte[nrs]?|angefragte[nrs]?|gewünschte[nrs]?|konnten?|kann|können|wurden?|werden|wird|ist|sind|war|waren|hat|haben|"
    r"zum|zur|zu|auf|von|vom|bei|beim|im|in|mit|für|an|am|aus|wegen|während|und|oder|nicht|mehr|leider|etwas|bitte|später|erneut|versuchen|laden|fehler|unerwarteter|"
    r"l[ae]|les|l|un|une|des?|du|d|ce|cet|cette|ces|votre|notre|nous|vous|il|elle|est|sont|a|ont|été|être|demandée?s?|sur|sous|dans|par|pour|avec|en|et|ou|au|aux|erreur|chargée?|affichée?|trouvée?|identifier|veuillez|réessayer|plus|tard|désolée?s?|inattendue?|"
    r"el|los|las|un|una|este|esta|estos|estas|su|sus|nuestr[oa]s?|se|lo|está|están|es|son|ha|han|ya|de|del|al|por|para|con|sobre|en|y|o|error|solicitad[oa]|cargar|cargarse|mostrar|mostrarse|encontrar|fallo|código|sentimos|inténtelo|más|tarde|inesperad[oa]|referencia|référence|reference|referenz"
)
_STANDIN = (
    r"\b(?:text|content|speech|answer|transcript|details|description) (?:to follow|coming soon|goes here)\b|^(?:sample|dummy|placeholder) (?:text|paragraph|content)|blindtext|platzhalter(?:text)?\b|mustertext|beispieltext|text folgt|inhalt folgt|"
    r"^texte (?:provisoire|factice|de remplissage)|faux texte|texte à venir|texto de (?:prueba|relleno|muestra|ejemplo)|texto (?:pendiente|provisional|simulado)|for layout only|für das layout|your text here|insert text|^coming soon\b|^under construction\b"
)
# Words without one of which no sentence is any of the above; words that end in error or exception count too.
_MARKS = (
    "found loaded displayed opened rendered shown retrieved reached processed completed accessed located fetched established resolved load display open render show retrieve reach process complete access locate find fetch connect "
    "available exist exists responding respond accessible authorised authorized allowed permitted online expired crashed moved deleted removed archived migrated updated failed lost refused reset closed timeout timed time denied forbidden restricted permission "
    "offline service down unavailable wrong requests redirects gateway request reply error occurred unauthorised unauthorized maintenance broken permanently "
    "gefunden geladen verfügbar erreichbar angezeigt geöffnet vorhanden dargestellt verarbeitet abgerufen existiert abgelaufen verschoben gelöscht entfernt migriert gewartet verweigert fehler vorübergehend fehlgeschlagen schiefgelaufen zeitüberschreitung aufgetreten wartungsarbeiten "
    "introuvable introuvables disponible accessible trouvé trouvée chargé chargée n'a n’a n'est n’est n'existe n’existe expiré refusé interdit déplacé déplacée supprimé supprimée archivé archivée migration indisponible impossible erreur délai "
    "podido pudo pudieron puede encontró encuentra encontrado encontrada existe caducado expirado denegado prohibido migrando movido movida eliminado eliminada espera mantenimiento "
    "java javascript script scripts cookie cookies browser navigateur navegador plug plugin plugins flash adblocker adblockers blocker blockers werbeblocker "
    "saved played sent submitted verified parsed read written started suspended blocked disabled locked terminated results busy sign continue corrupt corrupted abgespielt gespeichert beschädigt gesperrt rompu rompue corrompu corrompue suspendu suspendue bloqué bloquée perdido suspendido suspendida bloqueado bloqueada "
    "home start accueil inicio startseite menu imprint search sitemap impressum suche recherche buscar contact page form buscador log identifier reconnecter retry try https http traceback fatal warning uncaught "
    "text content speech answer transcript details description sample dummy placeholder blindtext platzhalter platzhaltertext mustertext beispieltext inhalt texte texto layout insert coming construction"
).split()
# ---- Fixed values: names of slots, and forms in which a slot stands.
_FIELDS = r"(?:first|last|full)?[ _]?names?|date|title|speaker|party|minister|member|district|agenda|vote|result|sitting|bill|number|address|text|place|time|topic|subject"
_SLOT_NAME = rf"(?:[A-Za-z]\w+(?:\.\w+){{1,4}}|[A-Za-z]\w*_\w+|(?i:{_FIELDS})(?: (?i:{_FIELDS}|no|here)){{0,4}})"
# Slots that begin with a sign, tried only where such a sign stands.
_SIGNED_SLOTS = [
    r"\{\{[^{}]*\}\}", r"\{%[^{}]*%\}", r"[$#]\{[^{}]*\}", r"\{[A-Za-z]\w+(?:[. ]\w+){0,4}\}", r"\$[A-Za-z_]{3,}",
    r"%\([^()\n]{1,40}\)[sdif]", r"%[A-Za-z][\w.]*(?: [A-Za-z][\w.]*)?%(?!\w)", r"@@[^@\n]{1,60}@@", r"__[A-Za-z][\w. ]*?__(?!\w)", r"_{4,}", r"\.{8,}",
    r"<<[^<>\n]{1,60}>>", r"<[A-Za-z][\w. ]*? HERE>", r"<[A-Za-z]\w*[_.]\w+>", r"<!--.*?-->", r"&lt;[A-Za-z][\w. ]*&gt;", rf"«(?:{_SLOT_NAME}|[A-Z_. ]+)»",
    r"\((?:undefined|null|none|nan)\)", r"\[(?:object Object|undefined|null|none|nan)\]", r"\[\[[^\[\]]*\]\]", r"\[[^\[\]\n]{1,30}\?\]", rf"\[{_SLOT_NAME}\]", r"\[[A-Z]+(?:\.[A-Z]+){1,4}\]",
    r"\[(?i:insert|enter|add|your|einsetzen|insertar|insérer)\b[^\[\]]*\]", r"\[[^\[\]]*\b(?i:to be (?:added|inserted|completed|confirmed)|einsetzen|einfügen|ergänzen|à compléter|à insérer|por completar|insertar|follows?)\]",
]
# Slots that are words in capitals.
_WORD_SLOTS = [
    r"[A-Z]{2,}(?:_[A-Z]{2,}){1,6}\b", r"(?:DD|MM|TT|JJ)[.\-/](?:MM|DD)[.\-/](?:YYYY|JJJJ|AAAA|YY)\b", r"YYYY-MM-DD\b", r"(?:TODO|FIXME|TBD|TBA|TBC)\b", r"X{3,}\b",
]
SLOT = rf"(?=[{{$#%@_.<&«(\[])(?<![\w$])(?:{'|'.join(_SIGNED_SLOTS)})|\b(?=[A-Z]{{2}})(?:{'|'.join(_WORD_SLOTS)})"
# Words of the standard filler text: those that no language of the corpus has, and the small ones between.
_LOREM = (
    r"dolore?|amet|consectetu(?:r|er)|consetetur|adipis[ci]+ng|elit|eiusmod|tempor|incididunt|labore|magna|aliqua|enim|minim|veniam|nostrud|exercitation|ullamco|laboris|nisi|aliquip|commodo|consequat|duis|aute|irure|"
    r"reprehenderit|voluptate|velit|esse|cillum|fugiat|nulla|pariatur|excepteur|sint|occaecat|cupidatat|proident|sunt|culpa|officia|deserunt|mollit|anim|laborum"
)
_LOREM_SMALL = r"sit|sed|do|ut|et|ad|quis|ex|ea|in|eu|non|qui|id|est|lorem|ipsum"
_FILLER = [
    r"(?:\b[xX]{2,}\b[\s.,]*){4}", r"(?i)(?:\b(test|text|bla|blah|foo|asdf)\b[\s.,]*)(?:\1\b[\s.,]*){3}",
    # many longer words in lower case without a single short one: no language of the corpus does that;
    # repeated groups are counted exactly, as Java matches them by recursion
    r"(?:\b\p{Ll}{4,}\b\s+){11}\p{Ll}{4,}\b", r"(?i)\blorem ipsum(?: \p{L}{4,}){5}",
    # the standard text with its short words and commas, or its first words alone on a line
    rf"(?i)\blorem ipsum(?:(?:[\s,.;:]+(?:{_LOREM_SMALL})){{0,4}}[\s,.;:]+(?:{_LOREM})\b){{4}}", r"(?im)^\W*lorem ipsum dolor sit amet\W*$",
]


def _masked(text: Column) -> Column:
    """The different sentences and lines of a text, in lower case with numbers masked.

    Interjections in round brackets and what leads a line are left out.
    """
    plain = F.regexp_replace(text, r"\([^()\n]{0,80}\)(?=\s*\p{Lu})", " ")
    parts = F.split(plain, r"(?<=[.!?])(?<!\b[Nn]o\.)(?<!\b[Nn]r\.)\s+|\n+")
    low = F.transform(parts, lambda s: F.regexp_replace(F.regexp_replace(F.lower(F.trim(s)), r"\b[45]\d\d\b", "<status>"), r"\d+(?:[.,]\d+)*", ANY))
    return F.array_distinct(F.filter(low, lambda s: s != ""))


def _word(words: str) -> str:
    return r"(?U)(?<![\p{L}\d])(?:" + words + r")(?![\p{L}\d])"


def _marked(sentence: Column) -> Column:
    """Whether a sentence says what messages say; patterns are only tried where a word of the vocabulary stands."""
    words = F.split(sentence, r"[^\p{L}’']+")
    marks = F.exists(words, lambda w: w.isin(_MARKS) | w.endswith("error") | w.endswith("exception") | w.endswith("serverfehler"))
    says = sentence.rlike(_word(f"{_FAILS}|{_SCRIPTS}")) | sentence.rlike(f"{_PROGRAM}|{_STANDIN}|{_NAVIGATION}")
    return F.when(marks, says).otherwise(False)


def _leaf(words: Column) -> Column:
    """The leaf of the prefix tree that a sentence belongs to."""
    return F.xxhash64(F.size(words), F.slice(words, 1, DEPTH), F.element_at(words, -1))


def _slot_and_filler(text: Column) -> Column:
    filler = F.lit(False)
    for pattern in _FILLER:
        filler = filler | text.rlike(pattern)
    kinds = F.array(F.when(text.rlike(SLOT), F.lit("slot")), F.when(filler, F.lit("filler")))
    return F.filter(kinds, lambda k: k.isNotNull())


def sentences(documents: DataFrame) -> DataFrame:
    """One row for each different sentence of a document: doc_id, of, key, words, kinds.

    `of` is the number of different sentences of the document, `key` the sentence's hash; `words` are
    given for sentences that say what messages say, the others are known by their hash. A document's first row has its `kinds` (slot, filler), which are looked for in the whole
    text. Null ids and texts give no rows.
    """
    text = F.col("text")
    docs = documents.where(F.col("doc_id").isNotNull() & text.isNotNull()).select("doc_id", _masked(text).alias("all"), _slot_and_filler(text).alias("kinds"))
    rows = docs.select("doc_id", F.size("all").alias("of"), "kinds", F.posexplode_outer("all").alias("at", "s"))
    return rows.select(
        "doc_id", "of", F.xxhash64("s").alias("key"), F.when(_marked(F.col("s")), F.split("s", r"\s+")).alias("words"),
        F.when(F.coalesce("at", F.lit(0)) == 0, F.col("kinds")).alias("kinds"),
    )


def templates(rows: DataFrame) -> DataFrame:
    """The templates of all sentences that have words: key, template, documents (of the sentence).

    Rows are `sentences`. Supports are counted for (leaf, place, word), reduced before they are
    exchanged, so a hot leaf is no task of its own.
    """
    said = rows.where("words is not null").select("doc_id", "key", "words").dropDuplicates(["doc_id", "key"])
    said = said.groupBy("key").agg(F.first("words").alias("words"), F.count(F.lit(1)).alias("documents"))
    said = cut(said.withColumn("leaf", _leaf(F.col("words"))))
    places = said.select("key", "leaf", "documents", F.posexplode("words").alias("at", "word"))
    support = places.groupBy("leaf", "at", "word").agg(F.sum("documents").alias("n"))
    placed = places.join(support, ["leaf", "at", "word"])
    plain = F.regexp_replace("word", r"[^\p{L}’']", "")
    stays = (F.col("n") >= LEAST_SUPPORT) | plain.isin(_MARKS)
    built = placed.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("at", F.when(stays, F.col("word")).otherwise(ANY).alias("w")))).alias("all"), F.count_if(~stays).alias("lost"))
    mined = F.when(F.col("lost") <= F.size("all") * MOST_VARIABLE, F.transform("all", lambda x: x["w"]))
    return said.join(built, "key").select("key", F.array_join(F.coalesce(mined, "words"), " ").alias("template"), "documents")


def mine_templates(documents: DataFrame) -> DataFrame:
    """The templates of the corpus: template, sentences (different ones), documents (with one of them, counted by sentence)."""
    return templates(sentences(documents)).groupBy("template").agg(F.count(F.lit(1)).alias("sentences"), F.sum("documents").alias("documents"))


def classify(template: Column) -> Column:
    """The kind of message a template is: script, error, filler or navigation; null for speech.

    A sentence that merely mentions failures is speech: of an error message nothing is left once
    its subject, its failure and the small words around them are taken away; one word may be if the
    message is short and its subject, or a failure that only programs report, is known.
    """
    has = lambda words: template.rlike(_word(words))
    rest = template
    for part in (_FAILS, _THING, _BESIDE):
        rest = F.regexp_replace(rest, _word(part), " ")
    left = F.regexp_replace(F.regexp_replace(rest, r"<\*>|<status>", " "), r"[^\p{L} ]+", "")
    nothing = F.length(F.trim(left)) == 0
    little = ~F.contains(F.trim(left), F.lit(" ")) & (F.size(F.split(template, " ")) <= 10) & (has(_FIRM) | has(_THING))
    question = template.endswith("?")
    return (
        F.when(has(_SCRIPTS) & has(_DEMANDS) & ~question, "script")
        .when(template.rlike(_PROGRAM) | (has(_FAILS) & (nothing | little) & ~question), "error")
        .when(template.rlike(_STANDIN), "filler")
        .when(template.rlike(_NAVIGATION), "navigation")
    )


def _beside(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Sentences known by their spread: doc_id, key of those that stand almost only on pages of messages.

    A page of messages is a document in which more than half of the other sentences are messages.
    Copies of one page are one witness: a sentence must stand beside LEAST_BESIDE different messages.
    """
    known = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("known"), F.min("key").alias("witness"))
    plain = rows.where("of > 1").join(known, "doc_id").where("2 * known > of - 1").join(found.select("doc_id", "key"), ["doc_id", "key"], "left_anti")
    likely = plain.groupBy("key").agg(F.countDistinct("doc_id").alias("pages"), F.countDistinct("witness").alias("witnesses"))
    likely = cut(likely.where(F.col("witnesses") >= LEAST_BESIDE))
    every = rows.join(likely, "key").select("doc_id", "key", "pages").distinct()
    sure = every.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.first("pages").alias("pages")).where(F.col("pages") >= F.col("n") * LEAST_SPREAD)
    return every.join(sure.select("key"), "key", "left_semi").select("doc_id", "key")


def residue(documents: DataFrame) -> DataFrame:
    """One row for each document and kind of residue: doc_id, kind.

    Kinds: script, error, filler, navigation (by template), beside (by spread among pages of
    messages), slot and filler (in the text). A document that is given twice counts once. Documents
    without residue give no row; sentences of any length are judged.
    """
    rows = cut(sentences(documents))
    mined = cut(templates(rows))
    kinds = mined.select("template").distinct().withColumn("kind", classify(F.col("template"))).where(F.col("kind").isNotNull())
    verdicts = mined.join(kinds, "template").select("key", "kind")
    found = cut(rows.where("words is not null").select("doc_id", "key").join(verdicts, "key").distinct())
    spread = _beside(rows, found).select("doc_id", F.lit("beside").alias("kind"))
    inside = rows.where(F.size("kinds") > 0).select("doc_id", F.explode("kinds").alias("kind"))
    return found.select("doc_id", "kind").unionByName(spread).unionByName(inside).distinct()


def without_residue(documents: DataFrame) -> DataFrame:
    """The documents that hold no residue, with all their columns; rows without doc_id or text too."""
    return documents.join(residue(documents).select("doc_id").distinct(), "doc_id", "left_anti").select(*documents.columns)
