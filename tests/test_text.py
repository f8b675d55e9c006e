import pytest
from tomeatlas.functions import geo, text, themes, titles
from tomeatlas.functions.trigram import query_trigrams, similarity, trigrams


@pytest.mark.parametrize(
    "raw, want",
    [("  A  B\tC ", "a b c"), ("ÉCOLE", "école"), ("", ""), ("　x ", "x"), ("a\x1cb", "a b")],
)
def test_norm_text(value, raw, want):
    assert value(text.norm_text("c"), c=raw) == want


def test_norm_text_of_null(value):
    assert value(text.norm_text("c"), c=(None, "string")) == ""


@pytest.mark.parametrize("raw, want", [("São Paulo!", "s-o-paulo"), ("--", "unknown"), ("", "unknown"), ("A  B", "a-b")])
def test_slug(value, raw, want):
    assert value(text.slug("c"), c=raw) == want


@pytest.mark.parametrize(
    "raw, display, query",
    [
        ("Kolkata/Calcutta", "Kolkata", "Kolkata"),
        ("Pune, Maharashtra", "Pune", "Pune, Maharashtra"),
        ("Oslo / Bergen", "Oslo", "Oslo"),
        ("New Delhi", "Delhi", "Delhi"),
        ("a very long description of some place (near Bhopal)", "Bhopal", "Bhopal"),
        ("one two three four five six seven eight nine ten", "one two three", "one two three four five six seven eight nine ten"),
        ("Tromsø", "Tromsø", "Tromsø"),
    ],
)
def test_sheet_city(value, raw, display, query):
    assert value(text.sheet_city("c"), c=raw) == {"display": display, "query": query}


@pytest.mark.parametrize(
    "label, parts, composite",
    [
        ("Paris and London; Rome", ["Paris", "London", "Rome"], True),
        ("A / A", ["A"], True),
        ("Andorra", ["Andorra"], False),
        ("Sand & Sea", ["Sand", "Sea"], True),
        ("", [], False),
        (" - , ", [], False),
    ],
)
def test_composites(value, label, parts, composite):
    assert value(text.composite_parts("c"), c=label) == parts
    if label.strip(" -,"):
        assert value(text.is_composite("c"), c=label) is composite


@pytest.mark.parametrize(
    "raw, want",
    [
        ("Point(77.2 28.6)", {"lon": 77.2, "lat": 28.6}), ("Point(-1e1 .5)", {"lon": -10.0, "lat": 0.5}),
        ("Point(77.2)", None), ("POINT(1 2)", None), ("Point(a b)", None), ("", None), ("Point(1d 2)", None),
    ],
)
def test_parse_point(value, raw, want):
    assert value(geo.parse_point("c"), c=raw) == want


@pytest.mark.parametrize("raw, want", [("1999-01-01", 1999), ("-044-03-15", -44), ("c.1900", None), ("", None), ("19", 19)])
def test_iso_year(value, raw, want):
    assert value(text.iso_year("c"), c=raw) == want


@pytest.mark.parametrize("raw, want", [("1999.7", 1999), (" 2001 ", 2001), ("unknown", None), ("", None), ("1e3", 1000)])
def test_loose_year(value, raw, want):
    assert value(text.loose_year("c"), c=raw) == want


@pytest.mark.parametrize(
    "raw, author, translator",
    [
        ("U. R. Ananthamurthy; Translated by A. K. Ramanujan", "U. R. Ananthamurthy", "A. K. Ramanujan"),
        ("One; Two", "One", None), ("Solo", "Solo", None), ("A ; trans. B", "A", None), ("A; translated into Hindi", "A", "Hindi"),
    ],
)
def test_author_of(value, raw, author, translator):
    assert value(text.author_of("c"), c=raw) == {"author": author, "translator": translator}


def test_languages(value):
    assert value(text.clean_language("c"), c="American  English") == "English"
    assert value(text.clean_language("c"), c="Tamil") == "Tamil"
    assert value(text.primary_language("c"), c=["xxx", "hin", "eng"]) == "Hindi"
    assert value(text.primary_language("c"), c=(None, "array<string>")) == "English"
    assert value(text.sheet_language("c"), c="Bangla (East)") == "Bengali"
    assert value(text.sheet_language("c"), c="Sindhi)") == "Sindhi"


def test_genres_and_themes(value):
    assert value(text.catalogue_genres("c"), c=["Detective tales", "Love stories"]) == ["mystery", "romance"]
    assert value(text.catalogue_genres("c"), c=["bolts"]) == ["literary fiction"]
    assert value(text.catalogue_themes("c"), c=["Women and war"]) == ["gender", "war"]
    assert value(text.subject_genres("c"), c=["Fiction", "Ghost stories", "Gothic", "xy", "Spy tales"]) == ["horror", "gothic fiction", "spy fiction"]
    assert value(text.form_genres("c"), c="Graphic novel") == ["literary fiction"]
    assert value(text.form_genres("c"), c="Short stories") == ["short stories"]


@pytest.mark.parametrize("raw, want", [("x-y", "X-Y"), ("war_trauma", "War Trauma"), ("caste", "Caste"), ("x y", "X Y")])
def test_theme_label(value, raw, want):
    assert value(text.theme_label("c"), c=raw) == want


@pytest.mark.parametrize("year, era", [(0, 0), (None, 0), (1899, 0), (1900, 1), (1949, 1), (1950, 2), (1980, 3), (2000, 4)])
def test_era_bucket(value, year, era):
    assert value(text.era_bucket("y"), y=(year, "int")) == text.ERAS[era]


def test_url_key_is_unpadded_and_safe(value):
    import base64

    for raw in ("wd-Q15005-Q649", "ü?>~", "a", "ab", "abc", "x" * 100):
        assert value(text.url_key("c"), c=raw) == base64.urlsafe_b64encode(raw.encode()).decode().rstrip("=")


def test_sanitize(value):
    assert value(themes.sanitize_themes("c"), c=["X-Y", "x_y", " ", "__A  b__", "c", "d", "e", "f", "g"]) == ["x_y", "a_b", "c", "d", "e", "f"]
    assert value(themes.sanitize_emotions("c"), c=["Eerie", "eeriness", "OBSESSIONS", "", "joy"]) == ["eeriness", "obsession", "joy"]
    assert value(themes.clamp_polarity("c"), c=-7.0) == -1.0


def test_grounding(value):
    assert value(themes.grounding_ok("c"), c=["war_trauma"]) is True
    assert value(themes.grounding_ok("c"), c=[]) is False
    assert value(themes.grounding_ok("c"), c=["war_trauma", "identity_social_experience"]) is False
    assert value(themes.grounding_ok("c"), c=["war_trauma", "velvet_protocol"]) is False
    feedback = value(themes.theme_feedback("c"), c=["velvet_protocol"])
    assert feedback.startswith("missing concrete anchor") and feedback.endswith("ornamental constructed suffix: velvet_protocol")


@pytest.mark.parametrize(
    "title, place, hit",
    [("Dubliners", "Paris", True), ("Dubliners", "Dublin", False), ("Bombay to Constantinople", "Rome", False), ("Bombay", "Mumbai", False), ("Bombay", "Pune", True), ("X", "Y", False)],
)
def test_title_city_mismatch(value, title, place, hit):
    assert value(titles.is_title_city_mismatch("t", "p"), t=title, p=place) is hit


@pytest.mark.parametrize(
    "title, hit",
    [("A Dictionary of Maqiao", False), ("Field Guide to X", True), ("An Encyclopedia", True), ("An Encyclopaedia", False), ("", False), ("The Surveyor", False)],
)
def test_nonfiction_title(value, title, hit):
    assert value(titles.is_nonfiction_title("t"), t=title) is hit


@pytest.mark.parametrize("title, hit", [("Q123", True), ("Poems", True), ("ab", True), ("", True), ("Ulysses", False), (" q9 ", True), ("Q12a", False)])
def test_ambiguous_title(value, title, hit):
    assert value(titles.is_ambiguous_title("t"), t=title) is hit


@pytest.mark.parametrize(
    "js, strict, relaxed",
    [
        ("{", "exception: malformed json", "exception: malformed json"),
        ("[1]", "not an object", "not an object"),
        ('{"polarity": 0}', "missing key: dominant_emotions", "missing key: dominant_emotions"),
        ('{"polarity":"x","dominant_emotions":[],"themes":[],"literary_mood":"a"}', "polarity not numeric", "polarity not numeric"),
        ('{"polarity":2,"dominant_emotions":[],"themes":[],"literary_mood":"a"}', "polarity out of range", "polarity out of range"),
        ('{"polarity":0,"dominant_emotions":["a"],"themes":["b"],"literary_mood":"ab"}', "dominant_emotions size invalid", "themes too few"),
        (
            '{"polarity":0,"dominant_emotions":["a","b","c"],"themes":["war_trauma","a_b","c_d","e_f"],"literary_mood":"quiet"}', "ok", "ok",
        ),
        (
            '{"polarity":0,"dominant_emotions":["a","b","c"],"themes":["war","a_b","c_d","e_f"],"literary_mood":"quiet"}',
            "themes format invalid", "missing abstraction theme",
        ),
        ('{"polarity":0,"dominant_emotions":"a","themes":"b","literary_mood":"ab"}', "dominant_emotions size invalid", "themes too few"),
    ],
)
def test_validation(value, js, strict, relaxed):
    assert value(themes.validation_reason("c", "strict"), c=js) == strict
    assert value(themes.validation_reason("c", "relaxed"), c=js) == relaxed


def test_lexicon_sentiment(value):
    assert value(themes.lexicon_sentiment("c"), c="love and peace, joy joy") == {"polarity": 1.0, "emotions": ["joy"]}
    assert value(themes.lexicon_sentiment("c"), c="used to be long ago") == {"polarity": 0.0, "emotions": ["neutral"]}
    got = value(themes.lexicon_sentiment("c"), c="grief tears joy dread home horizon")
    assert got == {"polarity": -0.33, "emotions": ["sadness", "joy", "fear"]}


def test_trigrams(value):
    assert sorted(value(trigrams("c"), c="Cat a")) == sorted(["  c", " ca", "cat", "at ", "  a", " a "])
    assert query_trigrams("Cat a") == sorted(["  c", " ca", "cat", "at ", "  a", " a "])
    assert value(similarity("c", "cat"), c="cat") == 1.0
    assert value(similarity("c", "word"), c="words") == pytest.approx(4 / 7)


def test_nonfiction_reason(value):
    row = {"book_title": "The Census", "author": "x", "genres": [], "passage": ""}
    assert value(titles.nonfiction_reason(), **row) == r"title matches: \bcensus\b"
    assert value(titles.nonfiction_reason(), **{**row, "genres": ["crime"]}) is None
    assert value(titles.nonfiction_reason(), **{**row, "book_title": "x", "genres": ["memoir"]}) == "pure memoir"
    assert value(titles.nonfiction_reason(), **{**row, "book_title": "x", "genres": ["biography", "memoir"]}) == "pure biography"
    assert value(titles.nonfiction_reason(), **{**row, "book_title": "pygmalion census"}) is not None
