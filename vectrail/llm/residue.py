"""Problem 8: template residue, dummy text, error pages and script notices.

Labelled exemplars of residue, a table of (label, text), are kept in an inverted index from word or mark to exemplars. A text is
cut into passage windows, for which the index retrieves exemplars; the containment of a window is the share of its TF-IDF mass
that exemplars cover. There are two kinds of windows. Lines and sentences are compared by their words with the best two
exemplars labelled notice, error or dummy; those of high containment are residue, and a text is residue if they make up most
of its mass. Spans from an opening to a closing mark are compared, marks included, with the exemplars labelled placeholder, in
which ~ stands for a name of up to four words, and with those labelled content, which look alike but are none (`__init__`); the
one that covers most, with most words of its own, decides. A text with a placeholder in its own sentences is residue.

Text in code, log lines, back-quotes and quotation marks is a mention and left out, but quotations count where nothing else is
there. Passages of one word do not suffice. Numbers, paths and site furniture (menus, footers) have no mass.

Inverse document frequencies of the exemplars' words and marks come from all texts; any other word weighs as much as one that a
thousandth of the texts hold. Null, empty and blank texts are no residue; rows with repeated ids are judged one by one.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrail.session import spread

# Labelled exemplars, one passage a line.
MOST_EXEMPLARS = 20_000
NOTICES = """
you need to allow scripts to view
loading if nothing happens switch on scripts and cookies
your browser does not support scripting the search box cannot load
active javascript para continuar ref
please enable javascript to use this console
please enable javascript to continue using this application
you need to enable javascript to run this app
this page requires javascript
veuillez activer javascript pour afficher
this site needs scripts to run
turn them on and reload
the dashboard stays blank as long as scripts are switched off
bitte aktivieren sie javascript um zu sehen
javascript is disabled in your browser
some parts of will not work
we are sorry but this app does not work properly without javascript enabled please enable it to continue
javascript must be enabled in order for you to use this site
please turn on javascript in your browser and refresh the page
this website uses scripts to function which your browser blocks allow them to continue
"""
ERRORS = """
checking that you are not a robot token
checking your browser before accessing
not found the page does not exist on this server
page not found
traceback newest call last
traceback most recent call last
file row in load
valueerror bad length
something went wrong on our side
try again later
panic runtime failure in shard
at probe lists line
at merge ranks line
at serve loop line
exit code
error index unavailable code trace
error the upstream node did not answer in time
internal server error
service unavailable
request
access to is denied
reference
this content is no longer available
the service is down for maintenance until
your session has expired
sign in to continue
seite wurde nicht gefunden fehler
connection reset while reading
backend fetch failed guru note
guru meditation
no se pudo cargar error interno
la page est introuvable
code
bad gateway edge
you have been rate limited
too many calls from your address retry in seconds
forbidden you do not have permission to access this resource on this server
unauthorized you must log in to view this page
the requested url was not found on this server
the server encountered an internal error or misconfiguration and was unable to complete your request
the website is temporarily unable to handle your request due to maintenance downtime or capacity problems
gateway timeout the server did not receive a timely response
an unexpected error has occurred please contact the administrator
this site cannot be reached check your connection
oops that page can not be found it looks like nothing was found at this location
"""
DUMMIES = """
texte factice à remplacer
placeholder copy do not translate
blindtext ohne inhalt
texto de ejemplo
test test test
blah blah blah
asdf asdf qwer
replace this paragraph before publishing
your content goes here
sample text for layout only
click or tap here to enter text
type your text here
this is placeholder text replace it with your own content
this is a sample page edit it to add your own text
sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium totam rem aperiam eaque ipsa quae ab illo inventore veritatis et quasi architecto beatae vitae dicta sunt explicabo
nemo enim ipsam voluptatem quia voluptas aspernatur aut odit aut fugit sed quia consequuntur magni dolores eos qui ratione sequi nesciunt
neque porro quisquam est qui dolorem ipsum quia dolor sit amet consectetur adipisci velit numquam eius modi tempora incidunt ut labore magnam aliquam quaerat
content xxxx foo etc bar baz text word qwerty lipsum dummy title
lantro vastus nulli aspera quelit sable contel verbit dextro dolorem leviter ornatu ridere quinte oblate minore prandem indole moreta sapent ullor xenium optare gratel plurim umbrel mendas calvis zephis pernix bonetu ficta manuet cursim vortex yaldor wisent emblat tardus tempit sodale fusca jubare hospem foruna mirabe novelt ruptim stolido tolore sagaro quasim
lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum
"""
FURNITURE = frozenset("home docs pricing status contact menu blog console search changelog sign in back to top ok notice".split())
#: Marks and names of placeholders; ~ is a name of the writer's choice.
PLACEHOLDERS = """
{{ ~ }}
{{{ ~ }}}
{ ~ }
${ ~ }
#{ ~ }
<%= ~ %>
<% ~ %>
[% ~ %]
[[ ~ ]]
%% ~ %%
% ~ %
@@ ~ @@
__ ~ __
*| ~ |*
&lt; ~ &gt;
( ~ goes here )
< your ~ >
< insert ~ >
< enter ~ >
[ your ~ ]
[ insert ~ ]
[ enter ~ ]
[ add ~ ]
[ TBD ]
[ TBD ~ ]
[ TBD : ~ ]
[ TODO ]
[ TODO ~ ]
[ TODO : ~ ]
[ company name ]
[ first name ]
[ last name ]
[ recipient name ]
"""
#: What looks like a placeholder: names that programs reserve, and tags written as entities.
LOOKALIKES = """
__ init __
__ main __
__ repr __
__ str __
__ len __
__ iter __
__ next __
__ call __
__ enter __
__ exit __
__ del __
__ new __
__ dict __
__ slots __
__ file __
__ all __
__ eq __
__ hash __
__ future __
__ getattr __
__ getitem __
&lt; b &gt;
&lt; i &gt;
&lt; em &gt;
&lt; p &gt;
&lt; br &gt;
&lt; div &gt;
&lt; span &gt;
&lt; a &gt;
&lt; h1 &gt;
&lt; h2 &gt;
&lt; h3 &gt;
&lt; ul &gt;
&lt; li &gt;
&lt; td &gt;
&lt; tr &gt;
&lt; strong &gt;
"""
MOST_EXEMPLARS = 20_000
#: A closing bracket that goes on as a link, a path or a list is a mark of its own, as is the brace of a formula's command.
LEX = re.compile(r"""\\[A-Za-z]*\{|\{{1,3}|\}{2,3}|\}/|\}|\$\{|\#\{|<%=?|%>|\[%|%\]|\[\[|\]\]|\](?=[(\[])[(\[]|[\[\]()<>]|%%|%|@@|__|\*\||\|\*|&lt;|&gt;|~|[^\W_]+(?:[_.\-][^\W_]+)*|[^\s]""")
#: Marks that end a word or a formula as often as they open a placeholder: they must not touch what is before or after them.
LOOSE = frozenset(["{", "%", "%%", "@@", "__"])
TOUCHING = re.compile(r"[\w$#{}^\\/]")
REACH = 96  # characters of a span at most
FENCE = re.compile(r"```.*?(?:```|\Z)", re.DOTALL)
INDENTED = re.compile(r"^(?: {4}|\t)[ \t]*\S.*$", re.MULTILINE)
QUOTED = re.compile(r'`[^`\n]*`|"[^"\n]*"|“[^”\n]*”|„[^“”\n]*[“”]|«[^»\n]*»|‘[^’\n]*’(?!\w)')
MARKS = re.compile(r"[`\"“„«‘]")
LOG = re.compile(r"^\W*\d{4}-\d\d-\d\d[ T]\d\d:\d\d:\d\d\S*\s+[A-Z]{3,8}\b.*$", re.MULTILINE)
CUT = re.compile(r"\n|(?<=[.!?…])\s+")
TAG = re.compile(r"</?[A-Za-z!][^<>]*>")
PATH = re.compile(r"(?<!\w)/\w[\w./\-]*")
WORD = re.compile(r"[^\W\d_]+(?:\d\w*)?")


def words(passage: str) -> list[str]:
    """Lower-cased words without digits in them."""
    if "/" in passage:
        passage = PATH.sub(" ", passage)
    return [w for w in WORD.findall(passage.lower()) if len(w) > 1 and w.isalpha()]


BLOCKS = {"notice": NOTICES, "error": ERRORS, "dummy": DUMMIES, "placeholder": PLACEHOLDERS, "content": LOOKALIKES}


def labelled() -> list[tuple[str, str]]:
    """(label, text) of the exemplars above."""
    return [(label, line) for label, block in BLOCKS.items() for line in block.strip().splitlines()]


def own_text(text: str, quoted: bool = False) -> str:
    """The text without code, log lines and, unless `quoted`, quotations."""
    if "```" in text:
        text = FENCE.sub(" ", text)
    if "    " in text or "\t" in text:
        text = INDENTED.sub(" ", text)
    if not quoted and MARKS.search(text):
        text = QUOTED.sub(" ", text)
    return LOG.sub(" ", text)


def plain(body: str) -> str:
    """The text without entities and tags."""
    if "&" in body:
        body = html.unescape(body)
    return TAG.sub(" ", body) if "<" in body else body


class Span:
    """An exemplar with marks at its ends."""

    def __init__(self, label: str, text: str):
        tokens = LEX.findall(text)
        self.label, self.open, self.close, self.inner = label, tokens[0], tokens[-1], [t.lower() for t in tokens[1:-1]]
        self.free = "~" in self.inner
        self.own = Counter(t for t in self.inner if t != "~")


class Matcher:
    """The inverted index and the judgement of a text."""

    def __init__(self, df: dict[str, int], texts: int, passage_share: float = 0.75, text_share: float = 0.5, span_share: float = 0.9, exemplars: list[tuple[str, str]] | None = None):
        rows = labelled() if exemplars is None else exemplars
        spans = [Span(label, text) for label, text in rows if label in ("placeholder", "content")]
        self.exemplars = [(label, frozenset(words(text))) for label, text in rows if label not in ("placeholder", "content")]
        self.index: dict[str, list[int]] = defaultdict(list)
        for i, (_, bag) in enumerate(self.exemplars):
            for w in bag:
                self.index[w].append(i)
        self.spans: dict[str, list[Span]] = defaultdict(list)
        for span in spans:
            self.spans[span.open].append(span)
        weight = lambda w: math.log(1 + texts / (1 + df.get(w, 0)))
        self.idf = {w: weight(w) for w in self.index}
        self.marks = {w: weight(w) for w in marks(rows)}
        self.opening = re.compile("|".join(map(re.escape, sorted(self.spans, key=len, reverse=True)))) if spans else None
        self.other = math.log(1 + texts / (1 + texts / 1000))
        self.passage_share, self.text_share, self.span_share = passage_share, text_share, span_share
        self.weight = {w: 0.0 if w in FURNITURE else v for w, v in self.idf.items()} | dict.fromkeys(FURNITURE, 0.0)

    def placeholder(self, own: str) -> float:
        """The containment of the first span that is a placeholder, or 0."""
        for start in self.opening.finditer(own) if self.opening else ():
            first = start.start()
            tokens = list(LEX.finditer(own[first : first + REACH]))
            touches = first > 0 and TOUCHING.match(own[first - 1])
            best = (0.0, 0, "")
            for span in self.spans.get(tokens[0][0], ()):
                end = next((i for i, t in enumerate(tokens) if i and t[0] == span.close), 0)
                after = first + tokens[end].end() if end else 0
                if not end or (span.open in LOOSE and (touches or (after < len(own) and (own[after].isalnum() or own[after] == "_")))):
                    continue
                best = max(best, (self.covered(span, [t[0].lower() for t in tokens[1:end]]), len(span.own), span.label))
            if best[0] >= self.span_share and best[2] == "placeholder":
                return best[0]
        return 0.0

    def covered(self, span: Span, inner: list[str]) -> float:
        """The share of a span's mass that an exemplar with its marks covers."""
        ends = self.marks[span.open] + self.marks[span.close]
        left = Counter(inner)
        left.subtract(span.own)
        if any(n < 0 for n in left.values()):
            return 0.0
        names = [t for t, n in left.items() for _ in range(n)]
        free = span.free and 0 < len(names) <= 4 and all(t[0].isalpha() for t in names) and sum(map(len, names)) > 1
        if free or not (names or span.free):
            return 1.0
        kept, lost = ends + sum(self.marks[t] * n for t, n in span.own.items()), self.other * max(1, len(names))
        return kept / (kept + lost)

    def reach(self, found: list[str]) -> tuple[float, float]:
        """(mass, mass of the exemplars' words) of words: no exemplar can cover more."""
        known = [x for x in map(self.weight.get, found) if x is not None]
        covered = sum(known)
        return covered + (len(found) - len(known)) * self.other, covered

    def passage(self, bag: Counter) -> tuple[float, float, str]:
        """(mass, containment, kind) of the words of a passage."""
        mass, gain = 0.0, defaultdict(float)
        for w, n in bag.items():
            weight = self.idf.get(w, self.other) * n
            hits = self.index.get(w, ())
            if w not in FURNITURE:
                mass += weight
            for i in hits:
                gain[i] += 0.0 if w in FURNITURE else weight
        if not mass or not gain:
            return mass, 0.0, ""
        first = max(gain, key=lambda i: (gain[i], -i))
        covered = self.exemplars[first][1]
        second = max((sum(self.idf[w] * n for w, n in bag.items() if w in self.exemplars[i][1] and w not in covered and w not in FURNITURE) for i in gain if i != first), default=0.0)
        return mass, (gain[first] + second) / mass, self.exemplars[first][0]

    def judge(self, text: str | None) -> tuple[str, float] | None:
        """(kind, share of the mass) if the text is residue."""
        if not text or not text.strip():
            return None
        own = own_text(text)
        found = self.placeholder(own)
        if found:
            return "placeholder", found
        for quoted in (False, True):
            body = plain(own_text(text, True) if quoted else own)
            total, most = self.reach(words(body))
            # residue passages have at least passage_share of their mass in exemplars' words, so this bounds their share
            if total and most < self.passage_share * self.text_share * total * (1 - 1e-9):
                return None
            residue, telling = Counter(), False
            for line in CUT.split(body) if total else ():
                found = words(line)
                mass, covered = self.reach(found)
                if mass and covered >= self.passage_share * mass:
                    mass, share, kind = self.passage(Counter(found))
                    if share >= self.passage_share:
                        residue[kind] += mass
                        telling |= len(set(found)) > 1
            if total:
                share = sum(residue.values()) / total
                return (residue.most_common(1)[0][0], share) if telling and share >= self.text_share else None
        return None


def marks(rows: list[tuple[str, str]]) -> set[str]:
    """What the exemplars of spans consist of, names apart."""
    return {t.lower() for label, text in rows if label in ("placeholder", "content") for t in LEX.findall(text)} - {"~"}


def exemplar_frequencies(docs: DataFrame, text_col: str, rows: list[tuple[str, str]]) -> DataFrame:
    """(word, df) of the exemplars' words and marks, over all texts; a task adds up before it hands on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs = sorted(t for t in marks(rows) if not t.isalnum())
        wanted = frozenset(w for label, text in rows if label not in ("placeholder", "content") for w in words(text)) | {t for t in marks(rows) if t.isalnum()}
        df: Counter = Counter()
        for batch in batches:
            for value in batch.column(0):
                text = value.as_py().lower()
                df.update(wanted.intersection(WORD.findall(text)))
                df.update([t for t in signs if t in text])
        yield pa.RecordBatch.from_arrays([pa.array(list(df), pa.string()), pa.array(list(df.values()), pa.int64())], ["word", "df"])

    return docs.select(text_col).where(F.length(text_col) > 0).mapInArrow(run, "word string, df bigint").groupBy("word").agg(F.sum("df").alias("df"))


def exemplar_table(spark: SparkSession) -> DataFrame:
    """(label, text): the exemplars of this module, to be taken as they are or added to."""
    return spark.createDataFrame(labelled(), "label string, text string")


def residue(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage_share: float = 0.75, text_share: float = 0.5, exemplars: DataFrame | None = None) -> DataFrame:
    """(id, kind, share) of the texts that are residue; kind: placeholder, notice, error or dummy. exemplars: (label, text), at
    most MOST_EXEMPLARS rows, label being one of these kinds or content; those of exemplar_table by default."""
    rows = [(r[0], r[1]) for r in (exemplars if exemplars is not None else exemplar_table(docs.sparkSession)).select("label", "text").where("text <> ''").limit(MOST_EXEMPLARS + 1).collect()]
    if len(rows) > MOST_EXEMPLARS:
        raise ValueError(f"more than {MOST_EXEMPLARS} exemplars")
    docs = spread(docs.select(id_col, text_col))
    texts = docs.where(F.length(text_col) > 0).count()
    df = {r["word"]: r["df"] for r in exemplar_frequencies(docs, text_col, rows).collect()}  # as many rows as the exemplars have words
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(df, texts, passage_share, text_share, exemplars=rows)
        for batch in batches:
            ids, kinds, shares = [], [], []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = matcher.judge(value.as_py())
                if found:
                    ids.append(key)
                    kinds.append(found[0])
                    shares.append(found[1])
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(kinds, pa.string()), pa.array(shares, pa.float64())], [id_col, "kind", "share"])

    return docs.where(F.length(text_col) > 0).mapInArrow(run, f"`{id_col}` {kind}, kind string, share double")


def without_residue(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs whose ids are not residue, with all their columns; rows without an id stay."""
    return docs.join(residue(docs, id_col, text_col, **how).select(id_col).distinct(), id_col, "left_anti")
