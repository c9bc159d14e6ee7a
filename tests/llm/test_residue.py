import pytest
from pyspark.sql import functions as F

pytest.importorskip("zonespark.llm")
from zonespark.llm import residue

FIELDS = [
    "Hi {{ first_name }}, thanks for asking.", "Dear %s,", "Welcome to {0}!", "Posted by ${user} in #{team}.", "Kind regards, [Your Name]", "You joined on [insert date here].", "Summary: &lt;plan&gt;", "Expected result: [score: TBD]",
    "<p>Real words.</p> As <<city>> wrote above.", "Hallo [HIER NAMEN EINFÜGEN], danke.", "Votre message <votre nom> a été déplacé.", "El plazo termina el [insertar fecha aquí].", "Olá [inserir nome aqui]!", "Steps: XXTICKETXX", "Tested with *|VERSION|* and it works.", "Reply to (user goes here).",
    "Real answer first.\n\nThe download is at {$link}.", "Please quote %ORDER_NO% in every reply.", "Welcome to __NAME__!", "Ask ~~TEAM~~ or @@USER@@ or $CITY$.", "{% ticket %} marked this.", "%(score)s of them <%= tag %>", "[[name]] and {plan}.",
]
NO_FIELDS = [
    "Replace `{{x}}` by `{{ y }}`.", "```\n{{ name }}\n```\nworks", "    <%= render @x %>\n\nis the line.", "> Hi {{ name }}\n\nis what I get.", 'It says "Dear %s," in the mail.', "Merge {a, b} and {c} by x.", "See note [3] and table [B] above.", "$HOME and %PATH% are set.", "As [OP] said.", "Edit: [solved], done.",
    "Press <Ctrl>+<S>, then <Enter>.", "The header <vector> is not found.", "I get [object Object] there.", "__init__ is called twice.", "A generic List<T> or Map<K, V> fails.", "[This write-up](http://a.b/c) covers it.", "Source: http://a.b [dead link]", "The mail goes out with {{ score }} in the subject instead of the value.", "It costs $7 or 3% more.",
    "<pre><code>{{ name }}</code></pre> is fine", "What does %s mean in the format string?", "For the sets {0} and {1, 2} it fails.", 'print(f"{month} rows")', "The template tag [insert weight here] is left in the printed map, why?", "",
]
PAGES = [
    "404 Not Found", "<html><body><h1>Menu</h1><p>410 Gone</p><p>Request ID: 77123</p></body></html>", "Please enable JavaScript and cookies to continue.", "MENU\n\nYOUR BROWSER IS NOT SUPPORTED.", "Diese Seite benötigt JavaScript in Ihrem Browser.", "Ce site nécessite JavaScript et les cookies dans votre navigateur.", "test 44 please delete",
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "Sign in   Register   Help\n\n- The server is down for maintenance.\n\nPowered by Rookery Board", "bla bla bla bla", "dkd;dshlk lkk fjgh", "xxxxxxxxxxxx", "Oops!  Could&nbsp;not connect to the database.", "Text goes here. Headline goes here", "Página no encontrada",
]
NO_PAGES = [
    "See the other answer.", "No.", "+1", "Enable JavaScript in the web view settings and the map appears.", "Return 410 Gone rather than 404 if it was removed.", 'I need a notice that says "This site requires cookies" above it.', "I filled the map with lorem ipsum text and now it overflows.", "A 500 Internal Server Error is in the log with its cause: the lock.",
    "Page not found appears when I open the map with zonekit.", "Sign in  Register  Help\n\nUse the second column.", "All rights reserved", "Menu", "", "...", "Test the second column first.",
]


@pytest.mark.parametrize("text", FIELDS)
def test_unfilled(text):
    assert residue.unfilled_fields(text)


@pytest.mark.parametrize("text", NO_FIELDS)
def test_not_unfilled(text):
    assert not residue.unfilled_fields(text)


@pytest.mark.parametrize("text", PAGES)
def test_page(text):
    assert residue.page_units(text) == (True, [])


@pytest.mark.parametrize("text", NO_PAGES)
def test_no_page(text):
    strong, left = residue.page_units(text)
    assert not strong or left


def posts(spark):
    made = [(i, 9000 + i, "Maps are slow", "en", "board", t) for i, t in enumerate([*FIELDS, *NO_FIELDS, *PAGES, *NO_PAGES, None])]
    # a line of furniture that no list knows, on pages of many threads; the same words in an answer elsewhere
    made += [(1000 + i, 2000 + i, "How to merge", "en", "mirror", f"Service unavailable\n\nMirror node seven of the archive\n\nRequest ID: {i}") for i in range(8)]
    made += [(1100 + i, 2100 + i, "How to merge", "en", "mirror", "Not found: Try it with the first rows.") for i in range(2)]
    # recurring, but told in answers too, and on the thread's subject
    made += [(1200 + i, 2200 + i, "Rows vanish", "en", "board", "Page not found\n\nThe merge drops rows twice.") for i in range(6)]
    made += [(1300 + i, 2300 + i, "Rows vanish", "en", "board", "The merge drops rows twice.") for i in range(6)]
    return spark.createDataFrame(made, "doc_id long, thread_id long, title string, lang string, source string, text string").withColumn("reason", F.lit("clash")).withColumn("unit", F.lit(1))


def test_residue(spark):
    got = {r["doc_id"]: r["reason"] for r in residue.residue(posts(spark)).collect()}
    n = [len(x) for x in (FIELDS, NO_FIELDS, PAGES, NO_PAGES)]
    want = {i: "field" for i in range(n[0])} | {i: "page" for i in range(n[0] + n[1], n[0] + n[1] + n[2])} | {1000 + i: "evidence" for i in range(8)}
    assert got == want
    assert residue.residue(posts(spark).where("false")).count() == 0


def test_long_texts():
    filler = "Lorem ipsum dolor sit amet. " * 20_000
    assert residue.page_units(filler) == (True, []) and not residue.unfilled_fields(filler)
    real = "The second column is sorted by key and then by date. " * 20_000
    assert residue.page_units(real)[0] is False
    assert residue.unfilled_fields(real + "Kind regards, [Your Name]") == ["[Your Name]"]


LATIN = """Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. Ut enim ad minim veniam,
quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat. Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla
pariatur. Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum."""


def test_whole_standard_filler():
    assert residue.page_units(LATIN) == (True, [])
    assert residue.page_units("Vivamus sagittis lacus vel augue laoreet rutrum faucibus.") == (True, [])
    for text in ("Non.", "Integer.", "In, do.", "Est-ce que non?"):
        assert residue.page_units(text)[1]


def test_pages_in_a_long_shell(spark):
    shell = [f"Shelf number {w} of the mirror" for w in ("one", "two", "three", "four", "five", "six", "seven", "eight")] + ["word " * 50 + "end"]
    made = [(i, 2000 + i, "How to merge", "mirror", "Service unavailable. " + "\n\nMenu\n\n".join(shell)) for i in range(8)]
    made += [(100 + i, 2100 + i, "How to merge", "board", f"Merge row {i} first, then its copies.") for i in range(30)]
    docs = spark.createDataFrame(made, "doc_id long, thread_id long, title string, source string, text string")
    assert residue.residue(docs).where("reason = 'evidence'").count() == 8


def test_lines_are_found_again_in_their_own_posts(spark):
    bodies = ["Service unavailable\n\nMirror node seven\nof the archive", "Service unavailable on mirror node seven", "Node seven of the mirror\nAll shelves of it\nService unavailable"]
    made = [(100 * k + i, 9000 + 100 * k + i, "How to merge", f"mirror {k}", body) for k, body in enumerate(bodies) for i in range(8)]
    docs = spark.createDataFrame(made, "doc_id long, thread_id long, title string, source string, text string")
    assert residue.page_units(bodies[1]) == (True, ["on mirror node seven"])
    assert {(r["doc_id"], r["reason"]) for r in residue.residue(docs).collect()} == {(r[0], "evidence") for r in made}


SHELF = "Service unavailable\n\nThis node with your shelf is resting"


def test_shared_words_of_few_titles_do_not_veto(spark):
    made = [(i, 2000 + i, f"Merge rows with column {i}" if i % 8 == 0 else f"Merge rows by column {i}", "mirror", SHELF) for i in range(40)]
    made += [(100 + i, 2100 + i, f"Sort rows with key {i}" if i % 8 == 0 else f"Sort rows by key {i}", "board", f"Sort row {i} first, then its copies.") for i in range(200)]
    # on the subject of nearly all its threads
    made += [(400 + i, 2400 + i, f"Tidewell loses row {i}", "tide", "Page not found\n\nTidewell has no such switch") for i in range(40)]
    # titles stand on the questions
    made += [(r[1], r[1], r[2], r[3], f"What is to be done in case {r[1]}?") for r in made]
    made = [(r[0], r[1], r[2] if r[0] == r[1] else None, *r[3:]) for r in made]
    docs = spark.createDataFrame(made, "doc_id long, thread_id long, title string, source string, text string")
    assert {r["doc_id"] for r in residue.residue(docs).collect()} == set(range(40))


def test_pages_without_any_listed_phrase(spark):
    rooms = ["board", "tide", "mirror"]
    # repeated on one host, on other subjects, under a line that real posts of the host carry too
    made = [(i, 2000 + i, f"Merge rows by column {i}", "mirror", "en", "Archive of the rook\n\nThe shelf is resting and will be back at noon") for i in range(30)]
    made += [(100 + i, 2100 + i, f"Sort rows by key {i}", rooms[i % 3], "en", f"{'Archive of the rook' if i % 3 == 2 else ''}\n\nSort row {i} first, then its copies.") for i in range(300)]
    # poor answers stand on all hosts alike, or are at home where their language is
    made += [(500 + i, 2500 + i, f"Keys clash in case {i}", rooms[i % 3], "en", "See the other answer.") for i in range(90)]
    made += [(700 + i, 2700 + i, f"Clés en double {i}", "forum", "fr", "Voir l'autre réponse.") for i in range(40)]
    # a line of the host alone, and one shown as code
    made += [(800 + i, 2800 + i, f"Lines vanish {i}", "mirror", "en", "Archive of the rook") for i in range(2)]
    made += [(850, 2850, "What is this", "mirror", "en", "```\nThe shelf is resting and will be back at noon\n```")]
    titled = [(r[1], r[1], r[2], r[3], r[4], f"What is to be done in case {r[1]}?") for r in made]
    docs = spark.createDataFrame([(r[0], r[1], None, *r[3:]) for r in made] + titled, "doc_id long, thread_id long, title string, source string, lang string, text string")
    assert {r["doc_id"]: r["reason"] for r in residue.residue(docs).collect()} == {i: "evidence" for i in range(30)}


def test_lines_of_questions_and_answers_alike(spark):
    gone, rest = "The shelf you asked for is closed.", "Come back at noon\n\nArchive of the rook"
    made = [(i, i, f"Merge rows by column {i}", "mirror", gone if i % 2 else f"{gone}\n{rest}") for i in range(1, 5)]
    made += [(10 + i, 2000 + i, None, "board", rest if i % 2 else gone) for i in range(6)]
    # poor answers, and sentences that questions share, stand in one kind alone; a greeting and thanks in both
    made += [(100 + i, 3000 + i, None, "board", "See the other answer.") for i in range(9)]
    made += [(200 + i, 200 + i, f"Keys clash in case {i}", "board", f"Hi all\n\nWhy do the keys of my table clash?\n\nIt is case {'abcdefghi'[i]} of many.\n\nThanks") for i in range(9)]
    made += [(300 + i, 200 + i, None, "board", "Thanks") for i in range(9)]
    # a short question about its title, and the answer that repeats it
    made += [(400 + i, 400 + i, "Why is the shelf empty?", "board", "The shelf is empty.") for i in range(4)] + [(450 + i, 400 + i, None, "board", "The shelf is empty.") for i in range(4)]
    # the page shown as code
    made += [(500, 500, "What is this", "board", f"`{gone}`\n\n{gone}"), (501, None, None, None, ""), (502, None, None, None, None)]
    docs = spark.createDataFrame(made, "doc_id long, thread_id long, title string, source string, text string").withColumn("unit", F.lit("clash"))
    found = {r["doc_id"]: r["reason"] for r in residue.residue(docs).collect()}
    assert found == {i: "evidence" for i in [*range(1, 5), *range(10, 16)]}
    assert residue.residue(docs.where("false")).count() == 0


UNTALKED = [
    "Hi {{ first_name }},\nplease use the new form instead of the old one.", "Dear [Your Name], use the second column instead of the first.", "Hallo [HIER NAMEN EINFÜGEN], nimm die zweite Spalte statt der ersten.",
    "Bonjour {{ nom }}, prenez la clé au lieu de la date.", "Hi {{ name }}, the syntax of the file is plain.", "Thanks %CUSTOMER%, escape the comma and it works.", "Dear {{ name }}, the old driver was replaced by a new one.",
    "Hola {{ nombre }}, usa la clave en lugar de la fecha.", "Hi {{ name }}, the mail goes out at noon instead of midnight.",
]
TALKED = [
    "I see {{ name }} instead of my name.", "The page shows {{ name }} literally.", "The placeholder {{ name }} stays.", "Im Kopf der Seite steht {{ name }} statt des Namens.", "La page montre {{ nom }} au lieu de la valeur.",
    "El informe muestra {{ nombre }} en lugar de el valor.", "The report prints {{ score }} in each row instead of the value.",
]


@pytest.mark.parametrize("text", UNTALKED)
def test_talk_of_other_things_fills_no_field(text):
    assert residue.unfilled_fields(text)


@pytest.mark.parametrize("text", TALKED)
def test_talk_of_the_field(text):
    assert not residue.unfilled_fields(text)
