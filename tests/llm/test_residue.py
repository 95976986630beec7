"""What is left of templates and servers, and what a newspaper may print."""

import re

import pytest

from tideline.llm.messages import anchor_pattern, fold, rules, squeeze, tree
from tideline.llm.residue import residue

CASES = [
    "The council met. {{headline}} The mill burned.", "{{ author }}", "{% block lead %}", "{{#each item}}", "<%= title %>", "<?= $name ?>", "${page.number}", "#{DATE}", "%%byline%%", "%(body)s", "%editor%", "@@issue_date@@", "[[caption]]",
    "__article_text__", "$ocr_text$", "{byline}", "«issue.volume»", "<caption goes\nhere>", "<<TITLE eintragen>>", "<<place à compléter>>", "<<vul BYLINE in>>", "[your text here]", "[INSERT EDITOR HERE]", "[insérer author ici]", "[DATE hier einfügen]",
    "[name hier invullen]", "[title: to be supplied]", "[TK - add\nsection]", "[Platzhalter: lead]", "(enter SECTION)", "Please enable JavaScript to view this page.", "Thls vlewer requlres scrlpts.", "CHECKING YOUR BROWSER BEFORE ACCESSING", "404 Not Found. The reque-\nsted page image",
    "Interner Serverfehier. Bitte versuchen Sie", "Page introuvahle. Erreur 9.", "Pagina niet gevonden (fouf 3).", "Lorem ipsum dolor sit amet", "menda torum dolum quassi agris", "texte texte texte texte", "null null null", "xxxx xxxxx xxx xxxx", "Traceback (most recent call last)", "Ihre Sitzung ist\nEINGESANDT abgelaufen",
    # wordings and languages that no test table has
    "Por favor, active JavaScript para ver esta página.", "Pagina non trovata. Abilita JavaScript", "Turn scripting on to continue", "Für diese Ansicht wird JavaScript benötigt.", "Error 404", "502 Bad Gateway nginx", "The requested URL was not found on this server.",
    "Morbi in sem quis dui placerat ornare. Pellentesque odio nisi, euismod in.", "This is placeholder text.", "TypeError: undefined is not a function", "Fatal error: Uncaught exception", "Uw sessie is helaas verlopen", "El servicio no está disponible: error interno del servidor",
    "tellum praetoris mandatum fructis agrorum venturis calidum nostris", "Votre navigateur ne prend pas en charge les scripts", "Error interno. Inténtelo de nuevo más tarde", "Titolo qui. Testo qui.", "placeholder placeholder placeholder", "Sample text sample text",
    "For example ${name} is set by the clerk. The council met. By ${byline}",
    "Mr. Fox  Too many re-\nsold two  quests. Wait 5\nhorses.  seconds and reload\nHe left.  the page.",
]
PRINTED = [
    "Engine No. 404 was not found at the depot.", "Die Lokomotive 404 wurde im Depot nicht gefunden.", "La page du registre demeure introuvable, dit le greffier.", "De bladzijde uit het register werd niet gevonden.", "Null and void, said the judge, null and void.", "The scripts required for the pageant have arrived.",
    "The session of the assembly has expired.", "Die Sitzung ist abgelaufen wie geplant.", "A timeout was called by the referee.", "Warning: the ice is not safe.", "The apprentices had set lorem ipsum on the trial sheet, and the foreman laughed.", "noted {sic} beside the figure", "Prices: $5 {see page 4} and 10% off.", "the sum {a, b, c}",
    "in five acts [the third is cut]", "<|endoftext|> </s> <unk> <pad>", "Name ____________ Street __________ Post", "Readers are asked to enable the post boy to pass.", "Access to the quarry was denied.", "« Le Matin » paraît", "___", "{", "100% of 20% went", "", " ", None,
    "Write the tag, for example {{name}}, in the sheet.", "Syntax: {{a}} {{b}} {{c}}", "No, no, no, no, no, no, no, no!", "Non, non, non, non!", "The surveyors had access denied to them by the constable.", "Der volle Text folgt in der nächsten Nummer.",
    "Il y avait un faux texte du testament.", "The stack trace of smoke rose.", "The manuscripts are on view to every viewer.", "Te Deum laudamus, te Dominum confitemur.", "Die Erwartung der Gäste war groß; der Saal war nicht verfügbar.", "Something went wrong with the engine.", "An error of 500 crowns in the accounts.",
    "La page du testament reste introuvable.", "The ferry crew sat before the viewer of Rowermere.", "Please try the soap again.", "Hear, hear, hear, hear!", "There were too many requests for tickets.", "Het onderhoud van de brug is begonnen.", "The text is to follow the sermon.",
]


def test_cases_and_print(spark):
    data = [(i, t) for i, t in enumerate(CASES)] + [(1000 + i, t) for i, t in enumerate(PRINTED)]
    df = spark.createDataFrame([(*r, "c", "c", 0) for r in data], "doc_id long, text string, read string, plain string, n int")
    got = {r.doc_id for r in residue(df).where("placeholder is not null or message is not null").collect()}
    assert [CASES[i] for i in range(len(CASES)) if i not in got] == []
    assert [PRINTED[i - 1000] for i in got if i >= 1000] == []
    assert residue(df).count() == len(data) and residue(df.limit(0)).count() == 0


def test_long_and_code(spark):
    long = "The council met again. " * 50_000
    df = spark.createDataFrame([(1, long), (2, long + "{{title}}"), (3, "In the sheet ```{{title}}``` and `{{a}}` stands."), (4, "Syntax: {{a}} {{b}} {{c}}")], "doc_id long, text string")
    assert sorted(r.doc_id for r in residue(df).where("placeholder is not null").collect()) == [2]


def test_density(spark):
    """Where most placeholders of a page are introduced, the page teaches; a page full of them that nothing introduces was never filled."""
    far = "The council met again. " * 20
    lesson = "".join(f"Fields are written such as {{{{f{i}}}}} in the sheet. " for i in range(5))
    df = spark.createDataFrame([(1, lesson + far + "{{byline}}"), (2, "{{a}} {{b}} {{c}} " + far), (3, lesson), (4, "Such as {{a}}. " + far + "{{b}} {{c}}")], "doc_id long, text string")
    assert sorted(r.doc_id for r in residue(df).where("placeholder is not null").collect()) == [2, 4]


@pytest.mark.parametrize("pair", [("viewer", "vlewer"), ("modern", "modem"), ("could", "coulcl"), ("browser", "hrovvser"), ("session", "5ession")])
def test_fold(pair):
    assert fold(pair[0]) == fold(pair[1])


def test_tree():
    words = ["abc", "abd", "x", "xyz", "b(c"]
    p = re.compile(tree(words))
    assert all(p.fullmatch(w) for w in words) and not p.search("ab b")


def test_anchors_cover_their_rules():
    """Whatever a rule matches holds one of its anchors: every word of an anchor is found by the quick pass."""
    quick = re.compile(anchor_pattern())
    for anchor, _ in rules():
        for word in anchor.split(","):
            assert quick.search(squeeze(word.replace(".", " "))), word
    found = ["please enable javascript", "404 not found", "your session has expired", "headline goes here", "key error"]
    assert all(quick.search(squeeze(x)) and any(re.search(p, squeeze(x)) for _, p in rules()) for x in found)


def test_alternating_columns(spark):
    """A message wrapped over the lines of one column, the lines of other columns in between."""
    first = ["The brass band", "bought 40 tons of", "coal. Access", "denied. You do not have per-", "mission to view this page,", "said nobody."]
    others = [["Mr. Fox sold", "two horses and", "left the fair", "before noon."], ["The mill", "burned", "down"]]
    placed = sorted((y, 40 + 500 * c, line) for c, column in enumerate([first, *others]) for y, line in enumerate(column))
    box = lambda x, y: (x + y % 3, 30 * y, 330, 20, None)
    wrapped, boxes = "\n".join(line for _, _, line in placed), [box(x, y) for y, x, _ in placed]
    pair = "\n".join(line for two in zip(first, ["a b", "c d", "e f", "g h", "i j", "k l"]) for line in two)
    schema = "doc_id long, text string, line_box array<struct<x int, y int, w int, h int, conf float>>"
    data = [(1, wrapped, boxes), (2, pair, []), (3, pair, None), (4, wrapped.replace("denied", "granted").replace("mission", "mit"), boxes), (5, None, None), (6, "", [])]
    found = lambda df: sorted(r.doc_id for r in residue(df).where("message is not null").collect())
    df = spark.createDataFrame(data, schema)
    assert found(df) == [1, 2, 3]
    assert found(df.where("doc_id in (2, 3, 4)").drop("line_box")) == [2, 3]


def test_every_placeholder_is_judged(spark):
    taught, far = "Write the tag, for example {{name}}, in the sheet. ", "The council met again. " * 100
    data = [taught + far + "{{headline}}", taught + far, "A mark such as [[caption]] or {{ issue.volume }} helps. " + far, taught + far + "[[caption]]", far + taught.replace("name", "name_of_the_editor_and_all_of_the_staff"), taught + taught.replace("{{name}}", "%%name%%") + far * 2]
    df = spark.createDataFrame(list(enumerate(data)), "doc_id long, text string")
    assert sorted(r.doc_id for r in residue(df).where("placeholder is not null").collect()) == [0, 3]


def test_every_column_side_by_side(spark):
    """A message wrapped over the lines of one of seven columns, the first, a middle or a late one, or beside an empty first column."""
    message, other = ["He said. Access", "denied. You may", "not come in."], ["an old mill", "a horse", "two carts"]
    at = lambda c: "\n".join("  ".join(message[i] if k == c else other[i] for k in range(7)) for i in range(3))
    empty = "\n".join(["coal and oil  " + message[0] + "  a fair", "   " + message[1] + "  and a", "tea  " + message[2] + "  ball"])
    plain = "\n".join("  ".join(other[i] for k in range(7)) for i in range(3))
    df = spark.createDataFrame(list(enumerate([*map(at, range(7)), empty, plain])), "doc_id long, text string")
    assert sorted(r.doc_id for r in residue(df).where("message is not null").collect()) == list(range(8))
