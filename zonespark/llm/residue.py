"""Template residue, filler, error pages and script notices in place of real content.

Two kinds of evidence flag a post:

* ``field``: an unfilled template field stands in the post's own prose. Code (fenced, indented,
  bare, inline, ``pre``), quoted lines and quoted strings are not own prose, and a field that its
  sentence talks about (as syntax, as a fault of a program; in words beside the field) is not unfilled.
* ``page``: the whole body, page furniture aside, is filler or test text, an error page's message,
  or a notice demanding scripts or cookies. The body is normalized (tags, entities, case, blanks,
  numbers) and all known phrases are taken out; nothing may be left over, and at least one of
  the phrases must be more than furniture.

Pages that carry phrases not in the lists are caught by combined evidence over the whole table. What
is left of a body is cut into lines. Lines that make up whole questions, off the subject of their
titles, as well as whole answers are a page's: see ``asked_and_answered``. And by host: and a line counts as furniture of a host
(``source``) if it recurs in several threads of the host, far oftener than on other hosts among posts
of the same language (answers of a few words recur everywhere alike), and its words are not the
subject of those threads' titles. A body whose left-over lines are all of that kind is page-like. It is
flagged if a phrase of the lists stands in it too, or one of its lines stands on hardly any post
that is not page-like. A table of one host has no such evidence.

Defined cases: null and empty texts are never flagged; texts are read whole, of any length;
repeated posts are flagged each; null titles, sources and threads only lack that evidence.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import materialize

# --- fixed values: phrases of pages, lower case, numbers written 9 ---

FURNITURE = """
menu
skip to content
sign in register help
home questions tags users log in
« back to the list
back to the list
about · terms · contact
about terms contact
all rights reserved
was this helpful? yes no
was this helpful?
yes no
loading answers...
cargando respuestas...
carregando respostas...
chargement des réponses...
antworten werden geladen...
checking your browser...
return to home page
nginx-like/9.9
nginx/9.9.9
request id: 9
reference: 9
wait 9 seconds
please wait
our team has been told
if you use an ad blocker, allow this site
cookie policy
privacy policy
""".strip().splitlines()

ERRORS = """
404 not found
9 not found
9 gone
9 forbidden
9 unauthorized
9 bad request
9 bad gateway
9 internal server error
9 service unavailable
9 gateway timeout
9 too many requests
gateway time-out (9)
gateway time-out
internal server error
service unavailable
bad gateway
bad request
page not found
access denied
forbidden
session expired
too many requests
this post is unavailable
something went wrong
oops!
we'll be right back
error 9
error 9 del servidor
fehler 9
erreur 9
erro 9
erro interno 9
9 – seite nicht gefunden
seite nicht gefunden
dienst nicht verfügbar
zugriff verweigert
hoppla!
page introuvable
accès refusé
service indisponible (9)
service indisponible
página no encontrada
acceso denegado
servicio no disponible
¡vaya!
página não encontrada
acesso negado
serviço indisponível
ops!
the page you were looking for could not be found
the requested address /q/9 was not found on this server
this content has been removed or never existed
the link you followed may be broken, or the thread may have been deleted
the server is down for maintenance
please try again later
could not connect to the database
an unexpected condition was met
you do not have permission to view this post
you are sending requests too quickly
please confirm that you are human to continue
the upstream host sent an invalid response
your session has timed out; please sign in again
fatal error: allowed memory of 9 bytes exhausted
warning: include(header_9): failed to open stream in view.php on line 9
die angeforderte seite existiert nicht
keine verbindung zur datenbank
sie haben keine berechtigung, diesen beitrag zu lesen
bitte versuchen sie es später erneut
ihre sitzung ist abgelaufen
la page demandée n'existe pas
connexion à la base de données impossible
veuillez réessayer plus tard
votre session a expiré
vous n'avez pas l'autorisation de voir ce message
la página solicitada no existe
no se pudo conectar con la base de datos
inténtelo de nuevo más tarde
su sesión ha caducado
no tiene permiso para ver este mensaje
a página solicitada não existe
não foi possível conectar ao banco de dados
tente novamente mais tarde
sua sessão expirou
você não tem permissão para ver esta mensagem
""".strip().splitlines()

FILLER = """
headline goes here
text goes here
your text here
write your answer here
enter content
type something meaningful here
body copy to follow
this is sample text
replace it with your own
second paragraph of example wording
dummy answer, please ignore
your introduction will appear in this place
add a short description of your post in this space
copy for this section has not been delivered yet
überschrift folgt
hier steht später ein text
dies ist blindtext
bitte inhalt ergänzen
titre à venir
votre texte ici
texte provisoire à remplacer
contenu de remplissage
título pendiente
aquí va el texto
texto de ejemplo, sustituir más tarde
contenido de relleno
título a definir
insira seu texto aqui
texto de exemplo a substituir
conteúdo provisório
test 9 post, ignore
test 9 please delete
test post, ignore
please delete
test again
test 9
test
testing
bla
blah
foo bar
foo
bar
baz
abc
asdf
qwerty
text
content
lorem
""".strip().splitlines()

#: Words of the filler text that imitates Latin.
LATIN = """
adipiscing aliqua aliquam aliquip amet anim aute cillum commodo consectetur consequat culpa cupidatat curabitur
deserunt dolor dolore duis eiusmod elit enim esse excepteur exercitation fugiat incididunt ipsum irure labore laboris
laborum ligula lorem magna mauris minim mollit nisi nostrud nulla nunc occaecat officia pariatur porta proident quis
reprehenderit sed sint sit sunt tempor tortor ullamco velit veniam vestibulum vitae voluptate
""".split()
#: Its words that are short or words of other languages too: filler only beside one of the above, or four in a row.
LATIN_BESIDE = """
ac accumsan ad aenean aliquet ante arcu auctor augue bibendum blandit condimentum congue convallis cras cursus dapibus
diam dictum dictumst dignissim do dui ea efficitur egestas eget eleifend elementum erat eros est et etiam eu euismod ex
facilisi facilisis fames faucibus felis fermentum feugiat finibus fringilla fusce gravida habitant habitasse hac hendrerit
iaculis id imperdiet in integer interdum justo lacinia lacus laoreet lectus leo libero lobortis luctus maecenas malesuada
massa mattis maximus metus mi morbi nam nec neque netus nibh nisl non nullam odio orci ornare pellentesque pharetra
phasellus placerat platea posuere potenti praesent pretium primis proin pulvinar purus quam qui quisque rhoncus risus
rutrum sagittis sapien scelerisque sem semper senectus sodales sollicitudin suscipit suspendisse tellus tempus tincidunt
tristique turpis ultrices ultricies urna ut varius vehicula vel venenatis vivamus viverra volutpat vulputate
""".split()

MIDDLE_ROW = "asdfghjkl;"

#: A demand for scripts or cookies: what opens it, what is demanded, how it may end.
DEMANDS = """
please enable
you need to enable
you must enable
enable
activate
please activate
turn on
please turn on
please allow
allow
this site requires
this page requires
this forum works only with
this page needs
sorry, this page needs
to view this answer, turn on
to continue, turn on
we could not load the thread without
it looks like your browser blocks
your browser blocks
bitte aktivieren sie
aktivieren sie
diese seite benötigt
ohne freigabe geht es nicht: erlauben sie
bitte erlauben sie
ce site nécessite
cette page nécessite
activez
autorisez
veuillez autoriser
veuillez activer
merci d'activer
este sitio necesita
este sitio requiere
esta página necesita
active
habilite
activa
este site precisa de
este site requer
esta página precisa de
ative
por favor, ative
""".strip().splitlines()
SCRIPTS = """
javascript support
javascript and cookies
cookies and scripts
client-side scripting
javascript
scripts
cookies
javascript und cookies
javascript-unterstützung
skripte und cookies
cookies und skripte
skripte
javascript et les cookies
les cookies et les scripts
javascript et cookies
cookies et scripts
les cookies
les scripts
javascript y las cookies
javascript y cookies
los scripts
las cookies
javascript e cookies
os scripts
os cookies
""".strip().splitlines()
ENDINGS = """
to continue
to see the answers
to run this app
before you sign in
and reload the page
in your browser settings
in your browser
to view this site
to use this site
to use this page
to use this forum
in ihrem browser
und laden sie die seite neu
um fortzufahren
dans votre navigateur
pour continuer
et rechargez la page
puis rechargez la page
en su navegador
para continuar
y recargue la página
no seu navegador
e recarregue a página
""".strip().splitlines()
UNSUPPORTED = """
your browser is not supported
ihr browser wird nicht unterstützt
votre navigateur n'est pas pris en charge
su navegador no es compatible
seu navegador não é compatível
""".strip().splitlines()

# --- fixed values: forms of unfilled template fields ---

#: A field's name: a word or some, joined by blanks, dots or underscores.
_NAME = r"[A-Za-z][\w]*(?:[ ._][A-Za-z]\w*)*"
FIELD_FORMS = [
    rf"\{{\{{[ ]?{_NAME}[ ]?\}}\}}",  # {{ name }}
    rf"\{{%[ ]?{_NAME}[ ]?%\}}",  # {% name %}
    rf"[$#]\{{{_NAME}\}}",  # ${name} #{name}
    rf"\{{\${_NAME}\}}",  # {$name}
    r"(?<![\w$#{])\{[A-Za-z]\w+\}(?!\})",  # {name}
    r"(?<![\w$#{])\{\d+\}(?!\})",  # {0}
    r"%\(\w+\)[sd]",  # %(name)s
    r"(?<![\w%])%s(?!\w)",  # %s
    r"(?<![\w%])%[A-Z][A-Z_]+%(?!\w)",  # %NAME%
    rf"<%=[ ]?{_NAME}[ ]?%>",  # <%= name %>
    rf"<<{_NAME}>>",  # <<name>>
    r"(?<![\w<])<[A-Z][A-Z_]+>(?![\w>])",  # <NAME>
    r"<(?:your|ihr|ihre|votre|su|seu|sua|tu|vos) [^<>\n]{1,40}>",  # <your name here>
    r"&lt;[A-Za-z][\w ]*&gt;",  # &lt;name&gt;
    rf"\[\[{_NAME}\]\]",  # [[name]]
    r"(?<![\w\]\[])\[[A-Z][A-Z]+(?:[ _][A-Z]+)*\](?![(\]\[])",  # [NAME]
    r"\[(?:your|ihr|ihre|votre|su|seu|sua) [^\[\]\n]{1,40}\]",  # [Your Name]
    r"\[(?:insert|enter|add)\s[^\[\]]{1,40}?(?:\shere)?\]",  # [insert name here]
    r"\[[^\[\]\n:]{1,40}: ?(?:tbd|tba|todo)\]",  # [name: TBD]
    r"\[hier [^\[\]]{1,40} einfügen\]",
    r"\[insérer [^\[\]]{1,40} ici\]",
    r"\[insertar [^\[\]]{1,40} aquí\]",
    r"\[inserir [^\[\]]{1,40} aqui\]",
    r"[(\[][\w ]{1,40} goes here[)\]]",  # (name goes here)
    r"(?<!\w)XX[A-Z]{2,}XX(?!\w)",  # XXNAMEXX
    r"~~[A-Z][A-Z_]+~~",  # ~~NAME~~
    r"@@[A-Z][A-Z_]+@@",  # @@NAME@@
    r"\*\|[A-Z][A-Z_]+\|\*",  # *|NAME|*
    r"(?<![\w$])\$[A-Z][A-Z_]+\$(?!\w)",  # $NAME$
    r"(?<!\w)__[A-Z][A-Z_]*?__(?!\w)",  # __NAME__
]
#: What looks like a field and is none: a poster, an environment variable, keys of a keyboard, numbered notes.
NO_FIELDS = {"[op]", "%path%", "%temp%", "%home%", "<enter>", "<ctrl>", "<esc>", "<tab>", "<alt>", "<shift>", "[solved]", "[dead link]", "[sic]"}
#: Words that talk about a field if they stand right before or after it, in the same line and sentence.
BEFORE_FIELD = r"(?:placeholders?|template tags?|format strings?|syntax|literally|escape|replace|what (?:does|is|do)|instead of|for the sets?|statt|anstelle von|au lieu de|en lugar de|en vez de|em vez d[oea]|ao invés de)"
AFTER_FIELD = r"(?:instead of|literally|as (?:a )?(?:placeholder|syntax)|syntax|placeholders?|in the (?:format string|template|syntax)|(?:is|are|was|gets?) (?:left in|replaced by|not replaced)|mean|statt|anstelle|au lieu de|en lugar de|en vez de|em vez d[oea]|ao invés)"
#: Programs and what they make, which a sentence can tell to show a field: the subject of a fault.
MAKERS = r"(?:template|mail|page|output|log|report|print\w*|header|export|program|script|function|app|vorlage|ausgabe|seite|modèle|sortie|page|plantilla|salida|página|modelo|saída)s?"


def _any(phrases: list[str]) -> str:
    """One pattern for all phrases, the longest that fits first: what they begin with is told once, so that a text is
    read along one branch whatever the number of phrases."""
    root: dict = {}
    for phrase in phrases:
        node = root
        for c in phrase:
            node = node.setdefault(c, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        ways = [("\\s" if c == " " else re.escape(c)) + pattern(below) for c, below in sorted(node.items()) if c]
        if not ways:
            return ""
        told = ways[0] if len(ways) == 1 and "" not in node else f"(?:{'|'.join(ways)})"
        return f"{told}?" if "" in node else told

    return f"(?:{pattern(root)})"


_DEMAND = rf"(?:{_any(DEMANDS)})\s(?:{_any(SCRIPTS)})(?:\s(?:{_any(ENDINGS)}))*"
_ALL_LATIN = rf"(?:{_any([*LATIN, *LATIN_BESIDE])})"
_LATIN = rf"(?:(?:{_any(LATIN_BESIDE)})[,;]?\s)*(?:{_any(LATIN)})(?:[,;]?\s{_ALL_LATIN})*|{_ALL_LATIN}(?:[,;]?\s{_ALL_LATIN}){{3,}}"
#: Furniture that names the board it stands on.
POWERED = r"powered by\s[\w-]+(?:\s(?:board|forum|forums|software))?"
_STRONG = rf"{_DEMAND}|{_any([*UNSUPPORTED, *ERRORS, *FILLER])}|{_LATIN}"
_PHRASES = re.compile(rf"(?<![\w'])(?:(?P<strong>{_STRONG})|(?:{POWERED}|{_any(FURNITURE)}))(?![\w'])")
_WORDS = re.compile(r"[^\W_]+")
#: The words that phrases are made of.
VOCABULARY = frozenset(w for phrases in (FURNITURE, ERRORS, FILLER, LATIN, LATIN_BESIDE, DEMANDS, SCRIPTS, ENDINGS, UNSUPPORTED, ["powered by board forum forums software"]) for phrase in phrases for w in _WORDS.findall(phrase))
_FIELDS = re.compile(rf"(?=[{{%$#<&\[(X~@*_])(?:{'|'.join(FIELD_FORMS)})", re.IGNORECASE)
#: What each form holds somewhere: a text without any of it has no field. All begin with a mark or letter of their own.
_SIGNS = re.compile(
    r"\{[{%$A-Za-z0-9]|%[(sA-Z]|\$[{A-Z]|#\{|<[%<]|<[A-Z][A-Z_]|<(?i:your|ihre?|votre|su|seu|sua|tu|vos) |&lt;[A-Za-z]|\[\[|\[[A-Z][A-Z]"
    r"|\[(?i:your|ihre?|votre|su|seu|sua|insert|enter|add|hier|insérer|insertar|inserir)\s|:[ ]?(?i:tbd|tba|todo)\]|XX[A-Z]|~~[A-Z]|@@[A-Z]|\*\|[A-Z]|__[A-Z]"
)
#: Forms that keep their case: %NAME%, [NAME] and the like are matched again without IGNORECASE.
_FIELDS_CASED = [re.compile(f, re.IGNORECASE if re.search(r"your|ihr|insert|hier|goes here|tbd", f) else 0) for f in FIELD_FORMS]
#: The field is marked by a NUL while the talk around it is looked for.
_TALK = re.compile(rf"\b{BEFORE_FIELD}\b(?: (?:the|a|an|das|der|die|le|la|el|o))?[ :]*\0|\0 ?(?:(?:shows?|appears?|stands?|comes|erscheint|steht|apparaît|aparece) )?{AFTER_FIELD}\b|\b{MAKERS}\b[^\0]*\0[^\0]*\b(?:instead of|statt|anstelle|au lieu de|en lugar de|en vez de|em vez d[oea]|ao invés)\b", re.IGNORECASE)
_TAGS = re.compile(r"</?(?:html|head|title|body|p|h\d|br|hr|div|span|center|ul|li|a|b|i|strong|em|small|nav|footer|header|main)\b[^<>]*>", re.IGNORECASE)
_CODE_BLOCKS = re.compile(r"^[ ]{0,3}(```|~~~).*?(?:^[ ]{0,3}\1[ ]*$|\Z)|<pre\b.*?(?:</pre>|\Z)|<code\b.*?(?:</code>|\Z)", re.IGNORECASE | re.DOTALL | re.MULTILINE)
_INLINE = re.compile(r"`+[^`\n]*`+")
_QUOTED = re.compile(r"\"[^\"\n]{1,300}\"|“[^”\n]{1,300}”|„[^“”\n]{1,300}[“”]|«[^»\n]{1,300}»")
_LINKS = re.compile(r"\[[^\[\]\n]*\]\([^()\s]*\)|https?://\S+")
#: A line of bare code: what no line of prose has.
_BARE = re.compile(r"[;{]\s*$|^\s*[}\])]+;?\s*$|^\s*(?:def|class|from|import|for|if|while|return|assert|select|where|group by|order by|print|echo|export|server|location)\b.*[(=:<>\"'_]|^\s*\w+\s*[+\-*/]?=\s*\S|^\s*</?\w+[^>]*>.*</?\w+[^>]*>\s*$|^\s*<%[-=]?[^%]*%>\s*$|^\s*\{%.*%\}\s*$|^\s*[$>]\s\w+|^\s*[\w./-]+ --\w")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n+")


_BULLETS = re.compile(r"(?m)^\s*(?:[-*•+#>=_]+\s+)+")
_BLANKS, _DIGITS = re.compile(r"[\s|]{2,}|[^\S ]|\|"), re.compile(r"\d+")
_UNITS = re.compile(r"(?<=[.!?])\s+|\n+")
#: Evidence for a line of page furniture: threads of a host it recurs in, and the share of page-like posts or of threads on another subject.
MIN_POSTS, MIN_SHARE = 5, 0.9
#: How many times likelier a line is on its host than elsewhere; and how seldom (one in so many, over all lines) chance may bring that about.
MIN_ODDS, MAX_CHANCE = 20, 1000
#: A word links a line to a subject if it is this many times commoner in the titles of the line's threads than in other titles.
MIN_LIFT = 3
#: Questions, and threads with answers, in which a line of a page recurs at least; the share of its questions that are nothing but such lines.
MIN_EACH, MIN_WHOLE = 2, 0.2
#: Lines (of 16 bytes) that are broadcast at most.
BROADCAST_LINES = 2_000_000
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def own_prose(text: str) -> str:
    """The text without code, quoted lines, quoted strings and links."""
    text = _CODE_BLOCKS.sub("\n\n", text.replace("\r\n", "\n"))
    lines = []
    for line in text.split("\n"):
        if line.startswith(("    ", "\t")) or line.lstrip().startswith((">", "&gt; ")):
            line = ""
        lines.append(line)
    bare = "\n".join("" if _BARE.search(html.unescape(line)) and not _carried(line) else line for line in lines)
    return _LINKS.sub(" ", _QUOTED.sub(" ", _INLINE.sub(" ", bare)))


def _carried(line: str) -> bool:
    """Whether a line that looks like code is a sentence all the same: words around the marks."""
    plain = _FIELDS.sub(" ", line)
    return len(re.findall(r"[^\W\d_]{2,}", plain)) >= 2 and not re.search(r"[=;{}<>_\"]|\(\S*\)|--", plain)


def _may_hold(text: str) -> bool:
    """Whether a text has a sign that any field has."""
    return _SIGNS.search(text) is not None or "goes here" in text.lower()


def unfilled_fields(text: str) -> list[str]:
    """The unfilled template fields of a text's own prose."""
    if not _may_hold(text) or all(m[0].lower() in NO_FIELDS for m in _FIELDS.finditer(text)):
        return []
    found = []
    for sentence in filter(_may_hold, _SENTENCE.split(own_prose(text))):
        for form in _FIELDS_CASED:
            for m in form.finditer(sentence):
                if m[0].lower() not in NO_FIELDS and not _TALK.search(f"{sentence[: m.start()]}\0{sentence[m.end() :]}"):
                    found.append(m[0])
    return found


def normalized(text: str) -> str:
    """A body as its words say it: tags, entities, case, blanks and bullets evened out, numbers as 9. Lines stay apart."""
    if "<" in text:
        text = _TAGS.sub("\n", text)
    if "&" in text:
        text = html.unescape(text)
    text = _BULLETS.sub("", text.replace("’", "'").replace("…", "..."))
    return _DIGITS.sub("9", _BLANKS.sub(lambda m: "\n" if "\n" in m[0] else " ", text).strip().lower())


def is_mash(text: str) -> bool:
    """Whether a whole body is one mark or word over and over, or keys of the keyboard's middle row in a row."""
    begins = text[:64].lower().split()
    if len(begins) > 2 and begins[0] != begins[1] and set(begins[0]) - set(MIDDLE_ROW) and len(set(begins[0] + begins[1])) > 1:
        return False
    words = text.lower().split()
    joined = "".join(words)
    if len(joined) < 6:
        return False
    return len(set(joined)) == 1 or (len(words) >= 4 and len(set(words)) == 1) or (len(words) >= 2 and not set(joined) - set(MIDDLE_ROW))


def unit_parts(unit: str) -> tuple[bool, list[str]]:
    """Whether a line or sentence has a strong phrase of a page, and what is left of it when all phrases are taken out.

    Where less than half of the words are words of phrases it is left as it is: no page, and soon told."""
    words = _WORDS.findall(unit)
    if 2 * sum(map(VOCABULARY.__contains__, words)) < len(words):
        return False, [unit]
    strong, left, at = False, [], 0
    for m in chain(_PHRASES.finditer(unit), [None]):
        part = _trimmed(unit[at : m.start()] if m else unit[at:])
        if part:
            left.append(part)
        if m:
            strong |= m["strong"] is not None
            at = m.end()
    return strong, left


def page_units(text: str) -> tuple[bool, list[str]]:
    """Whether a body has a strong phrase of a page, and what is left of its lines and sentences when all phrases are taken out, once each."""
    if is_mash(text):
        return True, []
    strong, left = False, {}
    for unit in _UNITS.split(normalized(text)):
        s, own = unit_parts(unit)
        strong |= s
        left.update(dict.fromkeys(u for u in map(_trimmed, own) if u))
    return strong, list(left)


def _trimmed(text: str) -> str:
    """A text without marks around it."""
    return text if text and text[0].isalnum() and text[-1].isalnum() else _EDGES.sub("", text)


def unit_number(unit: str) -> int:
    """The number under which a line is counted."""
    return xxhash.xxh3_64_intdigest(unit) - (1 << 63)


_SCHEMA = "doc_id bigint, thread_id bigint, n_fields int, strong boolean, shown boolean, on_title boolean, units array<bigint>"
_TERMS = re.compile(r"[^\W\d_]{4,}")


def _takes_up(title: str | None, text: str) -> bool:
    """Whether a text has a word of its title."""
    words = set(_TERMS.findall(title.lower())) if title else set()
    return bool(words) and not words.isdisjoint(_TERMS.findall(text.lower()))


def _examine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fields, strong, shown, on_title, left = [], [], [], [], []
        for text, title in zip(batch.column("text").to_pylist(), batch.column("title").to_pylist(), strict=True):
            s, own = page_units(text)
            fields.append(len(unfilled_fields(text)))
            strong.append(s)
            shown.append(bool(_CODE_BLOCKS.search(text) or _INLINE.search(text) or _QUOTED.search(text)))
            on_title.append(_takes_up(title, text))
            left.append([unit_number(u) for u in own])
        made = [pa.array(fields, pa.int32()), pa.array(strong, pa.bool_()), pa.array(shown, pa.bool_()), pa.array(on_title, pa.bool_()), pa.array(left, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("thread_id"), *made], ["doc_id", "thread_id", "n_fields", "strong", "shown", "on_title", "units"])


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``unit, text`` of the lines of texts."""
    for batch in batches:
        units = [u for text in batch.column(0).to_pylist() for u in page_units(text)[1]]
        yield pa.RecordBatch.from_arrays([pa.array([unit_number(u) for u in units], pa.int64()), pa.array(units, pa.string())], ["unit", "text"])


def residue(docs: DataFrame, min_posts: int = MIN_POSTS, min_share: float = MIN_SHARE) -> DataFrame:
    """``doc_id, reason`` (``field``, ``page`` or ``evidence``) of the posts that are residue.

    ``docs`` has ``doc_id, thread_id, title, source, text`` and may have ``lang``; other columns are not
    read. See ``host_furniture`` for the lines that count as furniture. A page-like post, all of whose
    left-over lines are furniture of its host, is flagged if it has a strong phrase or one of its lines
    stands on page-like posts in at least ``min_share`` of its posts.
    """
    lang = F.coalesce("lang", F.lit("")) if "lang" in docs.columns else F.lit("")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("thread_id").cast("bigint").alias("thread_id"), "title", "source", lang.alias("lang"), "text")
    texts = docs.select("doc_id", "thread_id", "title", "text").where("text is not null")
    # the units of all posts are made here once, so that a line of a page is the same line wherever it stands
    seen = materialize(texts.mapInArrow(_examine, _SCHEMA).where("n_fields > 0 or strong or size(units) > 0"), "residue")
    fields = seen.where("n_fields > 0").select("doc_id", F.lit("field").alias("reason"))
    pages = seen.where("n_fields = 0 and strong and size(units) = 0").select("doc_id", F.lit("page").alias("reason"))
    flagged = fields.unionByName(pages)

    each = seen.where("size(units) > 0").select("doc_id", "thread_id", F.coalesce(F.col("doc_id") == F.col("thread_id"), F.lit(False)).alias("asked"), F.explode("units").alias("unit"))
    # the lines of all posts are counted once, by threads; what recurs in fewer than any evidence asks for is left out
    threads = each.select("unit", "thread_id", F.col("asked").cast("int").alias("asked")).distinct().groupBy("unit").agg(F.sum("asked").alias("questions"), F.sum(1 - F.col("asked")).alias("answers"))
    threads = materialize(threads.where(F.col("questions") + F.col("answers") >= min(min_posts, 2 * MIN_EACH)), "lines")
    few = threads.count() <= BROADCAST_LINES
    each = materialize(each.join(F.broadcast(threads) if few else threads, "unit"), "recurring")
    alike = materialize(asked_and_answered(seen.where("n_fields = 0"), each), "alike")
    flagged = flagged.unionByName(alike.select("doc_id", F.lit("evidence").alias("reason")))

    # by host: of the bodies that nothing has flagged, those all of whose lines recur, and the posts with any of these lines
    often = each.where(F.col("questions") + F.col("answers") >= min_posts).select("doc_id", "unit")
    open_posts = seen.where("n_fields = 0 and not shown and size(units) > 0").join(alike, "doc_id", "left_anti").select("doc_id", "strong", F.size("units").alias("n_left"))
    whole = often.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).join(open_posts, "doc_id").where("k = n_left").select("doc_id")
    tried = materialize(often.join(whole, "doc_id", "left_semi").select("unit").distinct(), "tried")
    hosted = docs.where("source is not null").select("doc_id", "thread_id", "source", "lang")
    placed = often.join(F.broadcast(tried) if tried.count() <= BROADCAST_LINES else tried, "unit", "left_semi")
    placed = materialize(placed.join(hosted, "doc_id"), "placed")
    furniture = materialize(host_furniture(placed, hosted, docs, min_posts, min_share), "furniture")
    if furniture.isEmpty():
        return flagged
    known = placed.join(furniture, ["unit", "source"], "left_semi")
    page_like = known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_known")).join(open_posts, "doc_id").where("n_known = n_left").select("doc_id", "strong")
    lines = known.join(page_like, "doc_id", "left").groupBy("unit", "source").agg(F.count("strong").alias("paged"), F.count(F.lit(1)).alias("posts")).where(F.col("paged") >= min_share * F.col("posts"))
    carried = known.join(lines, ["unit", "source"], "left_semi").select("doc_id").distinct().withColumn("carried", F.lit(True))
    found = page_like.join(carried, "doc_id", "left").where("strong or carried")
    return flagged.unionByName(found.select("doc_id", F.lit("evidence").alias("reason")))


def asked_and_answered(seen: DataFrame, each: DataFrame, min_threads: int = MIN_EACH, min_whole: float = MIN_WHOLE) -> DataFrame:
    """``doc_id`` of the bodies that are nothing but lines which stand for questions and for answers alike.

    A question's lines recur in other questions, and a poor answer's in other answers; what is sent in place of a
    post stands under any title and in either. A line is such if it recurs in ``min_threads`` questions and in answers
    of ``min_threads`` threads, and if at least ``min_threads`` of the questions and a share ``min_whole`` of them are nothing
    but such lines, show none of it as code or quoted, and take up no word of their titles. That is found by taking away
    lines that fail, and bodies that have one, until nothing changes.

    ``seen`` has the bodies, ``each`` their recurring lines with the number of ``questions`` and of threads with ``answers``."""
    known = each.where((F.col("questions") >= min_threads) & (F.col("answers") >= min_threads))
    # a row for each body that is all of such lines, with its own lines
    lines = known.groupBy("doc_id").agg(F.first("asked").alias("asked"), F.collect_list(F.struct("unit", "questions")).alias("lines"))
    posts = seen.select("doc_id", "shown", (~F.col("shown") & ~F.col("on_title")).alias("fine"), F.size("units").alias("n"))
    bodies = materialize(lines.join(posts, "doc_id").where(F.size("lines") == F.col("n")), "bodies")
    left = bodies.count()
    while left:
        lines = bodies.select("doc_id", (F.col("asked") & F.col("fine")).cast("int").alias("whole"), F.explode("lines").alias("l")).select("doc_id", "whole", "l.*")
        good = lines.groupBy("unit", "questions").agg(F.sum("whole").alias("whole")).where((F.col("whole") >= min_threads) & (F.col("whole") >= min_whole * F.col("questions"))).select("unit")
        kept = lines.join(good, "unit").groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"))
        bodies = materialize(bodies.join(kept, "doc_id").where("k = n").drop("k"), "bodies")
        before, left = left, bodies.count()
        if left == before:
            break
    return bodies.where("not shown").select("doc_id")


def host_furniture(placed: DataFrame, hosted: DataFrame, docs: DataFrame, min_posts: int, min_share: float) -> DataFrame:
    """``unit, source`` of the lines that are furniture of a host.

    ``placed`` has the posts of recurring units (``unit, doc_id, thread_id, source, lang``). A unit is furniture of
    a host if it recurs in at least ``min_posts`` threads of it, at MIN_ODDS times the odds that posts of
    the same languages have to stand on that host, by more than chance over all units tried, and if at
    most 1 - ``min_share`` of the threads (or a single one) have a title on the unit's subject.
    """
    threads = placed.where("thread_id is not null").groupBy("unit", "source", "thread_id").agg(F.min("lang").alias("lang"))
    hosts = materialize(threads.groupBy("unit", "source").agg(F.count(F.lit(1)).alias("here")).where(F.col("here") >= min_posts), "hosts")
    everywhere = threads.groupBy("unit").agg(F.count(F.lit(1)).alias("n"))
    of_lang = hosted.groupBy("lang").agg(F.count(F.lit(1)).alias("all"))
    rates = hosted.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("own")).join(of_lang, "lang").select("source", "lang", (F.col("own") / F.col("all")).alias("rate"))
    expected = (
        threads.groupBy("unit", "lang").agg(F.count(F.lit(1)).alias("of_lang"))
        .join(hosts.select("unit", "source"), "unit")
        .join(rates, ["source", "lang"])
        .groupBy("unit", "source")
        .agg(F.sum(F.col("of_lang") * F.col("rate")).alias("expected"))
    )
    # the chance of so many threads on the host is at most exp(-n KL(q, p))
    q, p = F.col("here") / F.col("n"), F.col("expected") / F.col("n")
    rest = F.when(q < 1, (1 - q) * F.log((1 - q) / (1 - p))).otherwise(0.0)
    need = math.log(max(1, hosts.count()) * MAX_CHANCE)
    own = hosts.join(everywhere, "unit").join(expected, ["unit", "source"]).where((q * (1 - p) >= MIN_ODDS * (1 - q) * p) & (p < 1) & (F.col("n") * (q * F.log(q / p) + rest) >= need))
    own = materialize(own.select("unit", "source", "here"), "own")

    if own.isEmpty():
        return own.select("unit", "source")
    # what the lines say is read again, of the posts that have them
    chosen = own.select("unit").distinct()
    holders = placed.join(chosen, "unit", "left_semi").select("doc_id").distinct()
    words = docs.where("text is not null").join(holders, "doc_id", "left_semi").select("text").mapInArrow(_spelled, "unit bigint, text string").join(chosen, "unit", "left_semi")
    words = words.groupBy("unit").agg(F.first("text").alias("text")).select("unit", F.array_distinct(_terms(F.col("text"))).alias("words"))
    titles = docs.where("title is not null and doc_id = thread_id").select("thread_id", F.array_distinct(_terms(F.col("title"))).alias("title_words"))
    shared = (
        threads.join(own, ["unit", "source"]).join(words, "unit").join(titles, "thread_id")
        .select("unit", "source", "here", "thread_id", F.explode(F.array_intersect("words", "title_words")).alias("word"))
    )
    n_titles = F.lit(titles.count())
    common = titles.select(F.explode("title_words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("titles"))
    linking = (
        shared.groupBy("unit", "source", "here", "word").agg(F.count(F.lit(1)).alias("both"))
        .join(common, "word")
        .where(F.col("both") / F.col("here") >= MIN_LIFT * (F.col("titles") - F.col("both")) / F.greatest(F.lit(1), n_titles - F.col("here")))
        .select("unit", "source", "word")
    )
    about = shared.join(linking, ["unit", "source", "word"], "left_semi").groupBy("unit", "source", "here").agg(F.countDistinct("thread_id").alias("on_subject"))
    about = about.where((F.col("on_subject") > 1) & (F.col("on_subject") > (1 - min_share) * F.col("here")))
    return own.select("unit", "source").join(about, ["unit", "source"], "left_anti")


def _terms(text):
    """Words of four letters and more."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: F.length(w) >= 4)
