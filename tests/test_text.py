import unicodedata

from pyspark.sql import functions as F

from opinara.functions import labels as lb
from opinara.functions import lexicons as lx
from opinara.functions import text as tx


def test_cleaner_keeps_accents_or_not(one):
    rows = ["Visit http://x.co @bob #yay Très BON!!", "L'attente: 2h, trop cher...", "mekla BNINA 3aslama <3", None]
    assert one(lambda c: tx.clean_review(c, True), *rows) == [
        "visit très bon!!", "l'attente 2h trop cher...", "mekla bnina 3aslama 3", "",
    ]
    assert one(lambda c: tx.clean_review(c, False), *rows)[0] == "visit tr s bon!!"


def test_cleaner_on_long_junk(one):
    assert one(lambda c: tx.clean_review(c, True), "a" + "§" * 200_000 + "b") == "a b"


def test_strip_is_unicode_aware(one):
    assert one(tx.strip_ws, "　\t a b \xa0 \n") == "a b"


def test_nfc(one):
    raw = ["café", "plain", None, "Å"]
    expected = [None if r is None else unicodedata.normalize("NFC", r) for r in raw]
    assert one(tx.nfc, *raw) == expected


def test_repair_rules(one):
    rows = {
        "---": None,
        "- Sentiment": "- Sentiment",
        "Retail: Rapidité en caisse": "Retail: Rapidité En Caisse",
        "Qualité du service": "Service",
        "Propreté": "Hygiène",
        "Expérience globale": "Expérience globale",
        "Excellente ambiance": "Délais",
        "d'ambiance calme": "D'Ambiance Calme",
        "une phrase beaucoup trop longue ici": None,
    }
    assert one(lb.repair_label, *rows, None) == [*rows.values(), None]


def test_title_case_matches_python(one):
    rows = ["d'accueil été", "x2y l'ÉCOLE", "a-b_c", "ÇA VA"]
    assert one(lb.title_case, *rows) == [r.title() for r in rows]


def test_fix_label(one):
    assert one(lb.fix_label, "- Service | 4", "*  Prix", "a|b|c") == ["Service", "Prix", "a"]


def test_parse_label(one):
    assert one(lb.parse_label, "I think:\n\nSpeed (slow)\n", "speed", "", "x\n  \n", None) == [
        "Speed", *["Global_experience"] * 4,
    ]


def test_parse_label_score(one):
    def both(c):
        return F.concat_ws("/", *lb.parse_label_score(c))

    assert one(both, "x\nPrix | 2", "none", "Goût | a | 4") == [
        "Prix/2", "Expérience globale/3", "Goût/a | 4",
    ]


def test_normalize_prediction(one):
    assert one(lb.normalize_prediction, "Price value\nbecause", "Food", "Service-quality", "food") == [
        "Price_value", "Food_quality", "Service", "Global_experience",
    ]


def test_first_criterion_wins_and_pruning_changes_nothing(one, spark, data):
    def slow(text):
        return next((k for k, ws in lx.FRENCH_LEXICON.items() if any(w in text for w in ws)), None)

    texts = [w for ws in lx.FRENCH_LEXICON.values() for w in ws] + ["", "rien", "le plat et le prix"]
    assert one(lambda c: lb.keyword_hint(c, lx.FRENCH_LEXICON), *texts) == [slow(t) for t in texts]


def test_multi_label_keeps_three(one):
    names = lx.STRICT_TAXONOMY_FR
    got = one(lambda c: lb.multi_label(c, names), "Service, x,Prix , Hygiène,Accueil")
    assert got == ["Service", "Prix", "Hygiène"]


def test_whole_answer_tools(one):
    assert one(lambda c: tx.between_markers(c, "<a>", "<e>"), "q<a>one<e><a> two <e>z") == "two"
    assert one(lambda c: tx.last_line_with(c, "|"), "a|b\n c | d \nend") == "c | d"
    assert one(tx.word_count, "  a\xa0b c\n", "") == [3, 0]
