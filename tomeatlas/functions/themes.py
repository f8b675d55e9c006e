"""Themes, emotions, sentiment: clean-up, grounding checks, validation of enrichment output."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeatlas import vocab
from tomeatlas.functions.expr import (
    WHITESPACE_RUN,
    ColumnLike,
    col,
    contains_any,
    items,
    let,
    lookup,
    strings,
    strip,
    text,
)
from tomeatlas.functions.text import is_qid
from tomeatlas.functions.titles import title_geo_mismatch


def sanitize_themes(themes: ColumnLike = "themes") -> Column:
    """snake_case, without repeats, at most six."""

    def clean(t: Column) -> Column:
        return F.btrim(F.regexp_replace(F.lower(strip(t)), "[^a-z0-9]+", "_"), F.lit("_"))

    cleaned = F.transform(items(themes), clean)
    return F.slice(F.array_distinct(F.filter(cleaned, lambda t: t != "")), 1, 6)


def sanitize_emotions(emotions: ColumnLike = "emotions") -> Column:
    """Lower case, spellings unified, without repeats, at most five."""

    def clean(e: Column) -> Column:
        low = F.lower(strip(e))
        return F.coalesce(lookup(low, vocab.EMOTION_ALIASES), low)

    cleaned = F.transform(items(emotions), clean)
    return F.slice(F.array_distinct(F.filter(cleaned, lambda e: e != "")), 1, 5)


def clamp_polarity(c: ColumnLike = "polarity") -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.coalesce(col(c), F.lit(0.0))))


# ---- grounding of themes ----

def _tokens(theme: Column) -> Column:
    return F.filter(F.split(theme, "_"), lambda t: t != "")


def _has_token(theme: Column, words: list[str]) -> Column:
    return F.arrays_overlap(_tokens(theme), strings(words))


def _is_ornamental(theme: Column) -> Column:
    """Constructed ending ("x_protocol") without a concrete word beside it."""
    last = F.element_at(F.split(theme, "_"), -1)
    return last.isin(*vocab.ORNAMENTAL_ENDINGS) & ~_has_token(theme, vocab.ANCHOR_TOKENS)


def _is_all_abstract(theme: Column) -> Column:
    tokens = F.array_distinct(_tokens(theme))
    return (F.size(tokens) >= 3) & F.forall(tokens, lambda t: t.isin(*vocab.ABSTRACT_TOKENS))


def grounding_ok(themes: ColumnLike = "themes") -> Column:
    """A concrete word and an abstraction among the themes, and no constructed theme."""
    return let(
        items(themes),
        lambda ts: (
            F.exists(ts, lambda t: _has_token(t, vocab.ANCHOR_TOKENS))
            & F.exists(ts, lambda t: _has_token(t, vocab.ABSTRACTION_TOKENS))
            & ~F.exists(ts, lambda t: _is_ornamental(t) | _is_all_abstract(t))
        ),
    )


def theme_feedback(themes: ColumnLike = "themes") -> Column:
    """What is wrong with a set of themes, as one line."""

    def lines(ts: Column) -> Column:
        anchored = F.exists(ts, lambda t: _has_token(t, vocab.ANCHOR_TOKENS))
        abstracted = F.exists(ts, lambda t: _has_token(t, vocab.ABSTRACTION_TOKENS))
        whole_set = F.array(
            F.when(~anchored, F.lit("missing concrete anchor (institution/system/event/place-role)")),
            F.when(
                ~abstracted,
                F.lit("missing thematic abstraction (oppression/displacement/conflict/etc.)"),
            ),
        )
        each = F.flatten(
            F.transform(
                ts,
                lambda t: F.array(
                    F.when(_is_all_abstract(t), F.concat(F.lit("overly abstract construction: "), t)),
                    F.when(_is_ornamental(t), F.concat(F.lit("ornamental constructed suffix: "), t)),
                ),
            )
        )
        return F.array_distinct(F.array_compact(F.concat(whole_set, each)))

    joined = let(items(themes), lambda ts: F.array_join(lines(ts), "; "))
    return F.when(joined == "", F.lit("theme set failed quality heuristics")).otherwise(joined)


def _genre_words() -> Column:
    return F.split(F.lower(F.array_join(items("genres"), " ")), WHITESPACE_RUN)


def _is_humorous() -> Column:
    in_title = contains_any(F.lower(text("book_title")), vocab.HUMOR_WORDS)
    return F.arrays_overlap(_genre_words(), strings(vocab.HUMOR_WORDS)) | in_title


def _stereotyped_place() -> Column:
    return contains_any(F.lower(text("place_name")), vocab.STEREOTYPED_CITIES)


def _forced_themes() -> Column:
    forced = lookup(F.lower(strip("book_title")), {k: "|".join(v) for k, v in vocab.TITLE_THEMES.items()})
    return F.split(F.coalesce(forced, F.lit("")), r"\|")


def _count(array: Column, words: list[str]) -> Column:
    return F.size(F.filter(array, lambda t: t.isin(*words)))


def _has_city_lens(theme: Column) -> Column:
    return contains_any(theme, vocab.CITY_LENS_PARTS)


def with_generic_flag(df: DataFrame, out: str = "looks_generic") -> DataFrame:
    """Flag rows whose themes and emotions look generic, stereotyped or ungrounded."""
    df = df.withColumns({"_t": sanitize_themes("themes"), "_e": sanitize_emotions("emotions")})
    t, e = F.col("_t"), F.col("_e")
    title = F.lower(text("book_title"))
    forced = F.lower(strip("book_title")).isin(*vocab.TITLE_THEMES)
    children = F.arrays_overlap(_genre_words(), strings(vocab.CHILDREN_WORDS)) | F.contains(
        title, F.lit("madeline")
    )
    checks = [
        F.size(e) < 3,
        F.size(t) < 4,
        ~grounding_ok(t),
        forced & ~F.arrays_overlap(t, _forced_themes()),
        _count(t, vocab.GENERIC_THEMES) >= 2,
        _stereotyped_place() & (_count(t, vocab.STEREOTYPE_THEMES) >= 2),
        title_geo_mismatch() & F.exists(t, _has_city_lens),
        _is_humorous() & ~F.arrays_overlap(e, strings(vocab.PLAYFUL_EMOTIONS)),
        children & F.forall(e, lambda x: x.isin(*vocab.DARK_EMOTIONS)),
        contains_any(title, vocab.ADVENTURE_TITLE_PARTS) & ~F.arrays_overlap(t, strings(vocab.ADVENTURE_THEMES)),
        contains_any(title, vocab.COLLECTED_TITLE_PARTS) & ~F.arrays_overlap(t, strings(vocab.COLLECTED_THEMES)),
    ]
    return df.withColumn(out, reduce(lambda a, b: a | b, checks)).drop("_t", "_e")


def with_overrides(df: DataFrame) -> DataFrame:
    """Put in the themes a title, genre or place calls for and take out those it speaks against."""

    def six(array: Column) -> Column:
        return F.slice(F.array_distinct(array), 1, 6)

    def prefixed(array: Column, needed: Column, prefix: list[str]) -> Column:
        return six(F.when(needed, F.concat(strings(prefix), array)).otherwise(array))

    title, t, e = F.lower(text("book_title")), F.col("themes"), F.col("emotions")
    df = df.withColumns({"themes": sanitize_themes(), "emotions": sanitize_emotions()})
    adventure = contains_any(title, vocab.ADVENTURE_TITLE_PARTS)
    df = df.withColumn(
        "themes",
        prefixed(
            t,
            adventure & ~F.arrays_overlap(t, strings(vocab.ADVENTURE_THEMES)),
            ["civilization_versus_wilderness", "identity_reclamation"],
        ),
    )
    collected = contains_any(title, vocab.COLLECTED_TITLE_PARTS)
    df = df.withColumn(
        "themes",
        prefixed(
            t,
            collected & ~F.arrays_overlap(t, strings(vocab.COLLECTED_THEMES)),
            ["gothic_psychology", "analytic_detection"],
        ),
    )
    playful = F.arrays_overlap(e, strings(vocab.PLAYFUL_EMOTIONS))
    df = df.withColumn(
        "emotions",
        F.slice(
            F.array_distinct(
                F.when(_is_humorous() & ~playful, F.concat(strings(["mischief"]), e)).otherwise(e)
            ),
            1,
            5,
        ),
    )
    unwanted = strings(vocab.STEREOTYPE_THEMES)
    df = df.withColumn("themes", F.when(_stereotyped_place(), F.array_except(t, unwanted)).otherwise(t))
    df = df.withColumn(
        "themes",
        F.when(title_geo_mismatch(), F.filter(t, lambda x: ~_has_city_lens(x))).otherwise(t),
    )
    forced = F.filter(_forced_themes(), lambda x: x != "")
    df = df.withColumn("themes", six(F.concat(forced, t)))
    return df.withColumn("themes", F.filter(t, lambda x: ~(_is_all_abstract(x) | _is_ornamental(x))))


# ---- enrichment state of a row ----

def is_filler(themes: ColumnLike = "themes") -> Column:
    return _count(sanitize_themes(themes), vocab.FILLER_THEMES) >= 2


def needs_enrichment() -> Column:
    """Row whose sentiment is missing or thin and whose title is resolved."""
    has_passage = strip("passage") != ""
    polarity = F.coalesce(F.col("polarity"), F.lit(0.0))
    return (
        F.when(is_qid("book_title"), F.lit(False))
        .when(~has_passage, polarity == 0.0)
        .otherwise((F.size(items("emotions")) == 0) | (F.size(items("themes")) < 2) | (polarity == 0.0))
    )


# ---- validation of an enrichment result given as JSON text ----

# Keys, patterns and reasons.
RESULT_KEYS = ["polarity", "dominant_emotions", "themes", "literary_mood"]
_SNAKE = "^[a-z_]+$"
_SNAKE_WORDS = "^[a-z0-9]+(?:_[a-z0-9]+)+$"
REASONS = {
    "malformed": "exception: malformed json",
    "no_object": "not an object",
    "no_key": "missing key: ",
    "no_number": "polarity not numeric",
    "range": "polarity out of range",
    "emotions_size": "dominant_emotions size invalid",
    "emotions_format": "dominant_emotions format invalid",
    "themes_size": "themes size invalid",
    "themes_format": "themes format invalid",
    "mood_format": "literary_mood format invalid",
    "generic": "generic standalone theme",
    "few": "themes too few",
    "no_anchor": "missing concrete anchor theme",
    "no_abstraction": "missing abstraction theme",
}


def validation_reason(c: ColumnLike, mode: str = "strict") -> Column:
    """"ok" or the first rule that a result breaks; ``strict`` also checks sizes and spelling."""
    js = col(c)
    keys = F.json_object_keys(js)
    well_formed = F.try_parse_json(js).isNotNull()
    polarity = F.get_json_object(js, "$.polarity").try_cast("double")
    emotions = F.from_json(F.get_json_object(js, "$.dominant_emotions"), "array<string>")
    themes = F.from_json(F.get_json_object(js, "$.themes"), "array<string>")
    mood = F.coalesce(F.get_json_object(js, "$.literary_mood"), F.lit(""))

    def all_match(array: Column, pattern: str) -> Column:
        return F.forall(array, lambda x: F.coalesce(x.rlike(pattern), F.lit(False)))

    def sized(array: Column, low: int, high: int) -> Column:
        return F.coalesce(F.size(array).between(low, high), F.lit(False)) & array.isNotNull()

    def some_token(words: list[str]) -> Column:
        return F.coalesce(F.exists(themes, lambda t: _has_token(F.lower(t), words)), F.lit(False))

    reason = F.when(js.isNull() | ~well_formed, F.lit(REASONS["malformed"])).when(
        keys.isNull(), F.lit(REASONS["no_object"])
    )
    for key in RESULT_KEYS:
        reason = reason.when(~F.array_contains(keys, key), F.lit(REASONS["no_key"] + key))
    reason = reason.when(polarity.isNull(), F.lit(REASONS["no_number"])).when(
        ~polarity.between(-1.0, 1.0), F.lit(REASONS["range"])
    )
    if mode == "strict":
        anchors, abstractions = vocab.STRICT_ANCHORS, vocab.STRICT_ABSTRACTIONS
        mood_ok = F.length(mood).between(2, 40) & mood.rlike(_SNAKE)
        reason = (
            reason.when(~sized(emotions, 3, 5), F.lit(REASONS["emotions_size"]))
            .when(~all_match(emotions, _SNAKE), F.lit(REASONS["emotions_format"]))
            .when(~sized(themes, 4, 6), F.lit(REASONS["themes_size"]))
            .when(~all_match(themes, _SNAKE_WORDS), F.lit(REASONS["themes_format"]))
            .when(~mood_ok, F.lit(REASONS["mood_format"]))
            .when(
                F.arrays_overlap(themes, strings(vocab.STANDALONE_GENERIC)),
                F.lit(REASONS["generic"]),
            )
        )
    else:
        anchors, abstractions = vocab.RELAXED_ANCHORS, vocab.RELAXED_ABSTRACTIONS
        enough = F.coalesce(F.size(themes) >= 3, F.lit(False)) & themes.isNotNull()
        reason = reason.when(~enough, F.lit(REASONS["few"]))
    return (
        reason.when(~some_token(anchors), F.lit(REASONS["no_anchor"]))
        .when(~some_token(abstractions), F.lit(REASONS["no_abstraction"]))
        .otherwise(F.lit("ok"))
    )


def validate_enrichment(df: DataFrame, column: str = "result", mode: str = "strict") -> DataFrame:
    df = df.withColumn("reason", validation_reason(column, mode))
    return df.withColumn("ok", F.col("reason") == "ok")


# ---- lexicon sentiment ----

def lexicon_sentiment(c: ColumnLike) -> Column:
    """``struct(polarity, emotions)`` from the distinct words of a text.

    Entries of two words can never equal a single word and so never count.
    """
    lexicon = vocab.EMOTION_WORDS
    names = list(lexicon)
    every = sorted({w for words in lexicon.values() for w in words})
    hits = F.array_intersect(F.split(F.lower(text(c)), WHITESPACE_RUN), strings(every))

    def scored(found: Column) -> Column:
        return F.struct(
            *[F.size(F.array_intersect(found, strings(lexicon[n]))).alias(n) for n in names]
        )

    def result(s: Column) -> Column:
        positive = s["joy"] + s["wonder"]
        negative = s["sadness"] + s["fear"] + s["anger"]
        total = positive + negative + s["nostalgia"] + s["longing"]
        ranked = F.array_sort(
            F.array(*[F.struct((-s[n]).alias("s"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, n in enumerate(names)])
        )
        top = F.slice(
            F.transform(F.filter(ranked, lambda r: r["s"] < 0), lambda r: r["n"]), 1, 3
        )
        polarity = (positive - negative) / F.greatest(total, F.lit(1))
        return F.struct(
            F.round(polarity.cast("double"), 2).alias("polarity"),
            F.when(F.size(top) == 0, strings(["neutral"])).otherwise(top).alias("emotions"),
        )

    return let(let(hits, scored), result)


def setting_type(frequency: ColumnLike) -> Column:
    f = F.coalesce(col(frequency), F.lit(0))
    return F.when(f >= 5, F.lit("primary")).when(f >= 2, F.lit("secondary")).otherwise(F.lit("mentioned"))
