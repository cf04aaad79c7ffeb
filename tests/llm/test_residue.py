import pytest

from vectrail.llm import residue as R

CONTENT = "The merge policy reads the distance table twice while traffic doubles, and the team kept its notes for the next release."


@pytest.fixture(scope="module")
def matcher():
    return R.Matcher({"the": 900, "is": 700, "to": 800, "for": 700, "in": 800, "of": 800, "a": 800, "and": 900}, 1000)


@pytest.mark.parametrize(
    ("kind", "text"),
    [
        ("placeholder", "Dear {{ name }}, your index is ready."),
        ("placeholder", CONTENT + "\n\nStatus of [[region]] in ${namespace}: fine. " + CONTENT),
        ("placeholder", "To install (product goes here), open the console."),
        ("placeholder", "Author: [insert name here]"),
        ("placeholder", "This page describes &lt;title&gt;."),
        ("placeholder", "Limits: %%price%% vectors"),
        ("notice", "Home > Docs\nPlease enable JavaScript to use this console.\n© 2020 ab12"),
        ("notice", "<noscript>You need to allow scripts to view /kb/x1</noscript>"),
        ("error", "404 not found: the page /docs/a1 does not exist on this server."),
        ("error", '{"error": "index unavailable", "code": 503, "trace": "a1b2"}'),
        ("dummy", "Lorem ipsum dolor sit amet, consectetur adipiscing elit."),
        ("dummy", "Foo bar baz qwerty lipsum xxxx text."),
        ("placeholder", "Hello %FIRSTNAME%, your order has been sent."),
        ("placeholder", "Dear [First Name], thank you for the purchase."),
        ("placeholder", "Dear *|FNAME|*, here is the letter of this month."),
        ("placeholder", CONTENT + " Best regards, <Your Name>"),
        ("error", "403 Forbidden\nYou don't have permission to access /admin on this server."),
        ("error", "<h1>404</h1><p>The requested URL /x was not found on this server.</p>"),
        ("notice", "We're sorry but app doesn't work properly without JavaScript enabled. Please enable it to continue."),
        ("notice", "Please turn on JavaScript in your browser and refresh this page."),
        ("dummy", "Click or tap here to enter text."),
        ("dummy", "Nemo enim ipsam voluptatem quia voluptas sit aspernatur aut odit aut fugit."),
    ],
)
def test_residue(matcher, kind, text):
    assert matcher.judge(text)[0] == kind


@pytest.mark.parametrize(
    "text",
    [
        None,
        "",
        " \n\t",
        CONTENT,
        'The handler logs "access denied" together with the tenant and then closes the stream.',
        "Write `{{title}}` wherever the namespace should appear.",
        '```sh\ncurl ${HOST}/v1 -H "X: ${NS}"\necho "{{title}}"\n```\n' + CONTENT,
        '```json\n{"id": "a", "k": 35}\n```',
        "nprobe: 12\nbeta: 4",
        "2024-01-02 10:00:00 ERROR a1 connection reset while reading /x",
        "    search(ns, query, k=73)",
        "Visit [your account page](https://a.b) to see what the month has cost.",
        "You can [add a comment](url) below the article.",
        "Define __init__ in the class so that the object holds its fields.",
        "The set {a} has one element and {x} another one.",
        "The formula \\frac{ab}{cd} equals x_{ij} and e^{kt} in general.",
        "Rates rose from 5% to 10% in a year.",
        "The folder ${HOME}/bin must be searched for programs.",
        "A 404 page should say what to do next, and ours now leads to the search with a short guide for readers.",
        "Our style guide asks writers to avoid lorem ipsum in drafts that customers may see.",
        "Enable JavaScript modules in the settings of the bundler, then compare the sizes of both outputs.",
    ],
)
def test_content(matcher, text):
    assert matcher.judge(text) is None


def test_table(spark):
    rows = [(1, "Please enable JavaScript to use this console.", "clash"), (1, "Please enable JavaScript to use this console.", "clash"), (2, CONTENT, ""), (3, None, ""), (4, "", ""), (None, CONTENT, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, kind string")
    assert [(r.doc_id, r.kind) for r in R.residue(docs).collect()] == [(1, "notice")] * 2
    assert sorted((r.doc_id or 0) for r in R.without_residue(docs).collect()) == [0, 2, 3, 4]
    assert R.residue(docs.limit(0)).count() == 0


def test_exemplars_are_an_input(spark):
    docs = spark.createDataFrame([(1, "Kein Anschluss unter dieser Nummer."), (2, "Hallo (hier Vorname), willkommen."), (3, "Hallo {{ name }}.")], "doc_id bigint, text string")
    own = spark.createDataFrame([("error", "kein anschluss unter dieser nummer"), ("placeholder", "( hier ~ )"), ("error", None)], "label string, text string")
    assert sorted((r.doc_id, r.kind) for r in R.residue(docs, exemplars=own).collect()) == [(1, "error"), (2, "placeholder")]
    assert sorted(r.doc_id for r in R.residue(docs, exemplars=own.unionByName(R.exemplar_table(spark))).collect()) == [1, 2, 3]
    assert R.residue(docs, exemplars=own.limit(0)).count() == 0


def test_what_nobody_listed_may_be_missed(matcher):
    """Leaving out one exemplar at a time says how far the others cover it; most of the lists are needed."""
    rows = [r for r in R.labelled() if r[0] in ("notice", "error")]
    found = 0
    for row in rows:
        rest = R.Matcher({"the": 900, "is": 700, "to": 800}, 1000, exemplars=[r for r in R.labelled() if r != row])
        found += rest.judge(row[1]) is not None
    assert 0.15 < found / len(rows) < 1
