"""Quality rules whose cutoffs come from labelled documents, with a proven bound on wrongly rejected good ones in each stratum."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomeatlas.llm.labelled import fold
from tomeatlas.llm.stored import Stored
from tomeatlas.llm.words import NOT_BLANK, mixed, windows, word_hashes, words_of

BLANKS = " \t\n\x0b\x0c\r"
#: Documents with fewer words, or with a larger share (in a hundred) of words in repeated windows, fail without a test.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Share of a stratum's good documents that all rules together may reject, and the chance that this fails in any stratum.
ALPHA, DELTA = 0.05, 0.05
#: Folds of labelled rows; those in fold 0 propose cutoffs, the others test them.
FOLDS = 4
#: What a rejected good document counts for against a rejected bad one, both as shares, in a proposal.
PENALTY = 10
#: Values of a rule above this are counted as this.
TOP = 5000

_IS = np.zeros(256, np.uint8)
_SYMBOL, _UPPER, _START = 1, 2, 4
_IS[np.frombuffer(b"#*$%&|<>", np.uint8)] |= _SYMBOL
_IS[65:91] |= _UPPER
_IS[:128] |= _START
_IS[192:] |= _START


def _repeated(h: np.ndarray, at: np.ndarray, doc: np.ndarray, n_words: int) -> np.ndarray:
    """Words that stand in a 3-word window found twice or more in their text."""
    key = mixed(h ^ mixed(doc[at].astype(np.uint64) + np.uint64(1)))
    _, back, times = np.unique(key, return_inverse=True, return_counts=True)
    hit = np.zeros(n_words + 3, bool)
    again = at[times[back] > 1]
    for j in range(3):
        hit[again + j] = True
    return hit[:n_words]


def text_facts(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Counts of every whole text, in one scan: the columns ``carry`` and n_words, word_chars, n_symbols, n_upper, n_lines, n_dup_lines, n_repeat_words.

    Words are runs without ASCII blanks, as they are written. word_chars counts their code points, n_upper those from A to
    Z; n_lines lines with a word, n_dup_lines those equal to an earlier one of the text; n_repeat_words the words in
    3-word windows that the text has twice or more (windows are told apart by 64-bit hashes). A null or empty text
    counts zero throughout.
    """
    carry = ["doc_id"] if carry is None else carry
    names = ["n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines", "n_repeat_words"]
    own = docs.select(F.struct(*[F.col(c) for c in carry]).alias("row"), F.col("text").alias("text"))

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words_of(batch["text"], NOT_BLANK):
                n = len(w.count)
                kind = _IS[w.raw]
                per_text = lambda flag: np.diff(np.concatenate([[0], np.cumsum(flag)])[w.offsets])  # noqa: E731, B023
                exact = replace(w, hash=word_hashes(w.raw, w.start, w.end))
                h, at = windows(exact, 3)
                doc = w.doc - w.first
                hit = _repeated(h, at, doc, len(doc))
                lines, again = [], []
                for t in batch["text"].slice(w.first, n).to_pylist():
                    own = [x for x in t.split("\n") if x.strip(BLANKS)] if t else []
                    lines.append(len(own))
                    again.append(len(own) - len(set(own)))
                columns = [w.count, per_text((kind & _START > 0) & NOT_BLANK[w.raw]), per_text(kind & _SYMBOL > 0), per_text(kind & _UPPER > 0), lines, again, np.bincount(doc, weights=hit, minlength=n)]
                yield pa.record_batch([batch["row"].slice(w.first, n), *[pa.array(np.asarray(c, np.int64)) for c in columns]], names=["row", *names])

    schema = f"row {own.schema['row'].dataType.simpleString()}, " + ", ".join(f"{x} long" for x in names)
    return own.mapInArrow(counted, schema).select("row.*", *names)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


#: What each rule looks at, as whole numbers; a document is rejected at or above the cutoff.
RULES = {
    "symbols": "1000 * n_symbols div greatest(word_chars, 1)",
    "capitals": "1000 * n_upper div greatest(word_chars, 1)",
    "repeated_lines": "1000 * n_dup_lines div greatest(n_lines, 1)",
    "repeated_words": "1000 * n_repeat_words div greatest(n_words, 1)",
    "long_words": "100 * word_chars div greatest(n_words, 1)",
}


def _values() -> Column:
    return F.array(*[F.struct(F.lit(name).alias("rule"), F.least(F.expr(v), F.lit(TOP)).cast("long").alias("value")) for name, v in RULES.items()])


def binomial_tail(x: int, n: int, p: float) -> float:
    """Chance of at most ``x`` among ``n`` that each happen with chance ``p``, summed exactly."""
    if x >= n:
        return 1.0
    k = np.arange(x + 1, dtype=float)
    steps = np.log(n - k[:-1]) - np.log(k[1:]) + (np.log(p) - np.log1p(-p)) if x else np.zeros(0)
    logs = n * np.log1p(-p) + np.concatenate([[0.0], np.cumsum(steps)])
    top = logs.max()
    return float(min(1.0, np.exp(top) * np.exp(logs - top).sum()))


def _p_values(x: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    return pd.Series([binomial_tail(int(a), int(b), float(c)) for a, b, c in zip(x, n, p)], dtype="float64")


def certified_cutoffs(labelled: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The cutoff of each rule in each stratum, for rows with stratum, doc_id, label (1 good, 0 bad) and the counts of ``text_facts``.

    Rows of one fold propose: every value that one of their bad rows has is a candidate, looser ones first, and is worth the
    share of bad rows rejected less ``PENALTY`` times that of good ones. The other rows test. If more than alpha / rules of a
    stratum's good documents were rejected at a candidate, as few as are rejected among its tested good rows would be seen
    with a chance of at most the exact binomial tail. A candidate passes if that is at most delta / (strata x rules), which
    corrects for all tests: within a rule, stricter candidates are tested only after looser ones have passed, which costs
    nothing. So with a chance of 1 - delta, no stratum loses more than alpha of its good documents to all its rules together.
    Of the candidates that pass, the one worth most is taken (the looser of equals), if it is worth anything.

    All labelled rows count, as sums by stratum, rule and value; nothing is sampled or sent to the driver. Strata with
    too few labelled rows get no cutoff, and lose no document but to the base rules.

    Returns stratum, rule, cutoff, tested (good rows), rejected (of them), p_value.
    """
    rows = labelled.where(~base_failed()).select("stratum", "label", (fold("doc_id", FOLDS) == 0).alias("proposes"), F.explode(_values()).alias("v"))
    good, proposes = F.col("label") == 1, F.col("proposes")
    counts = rows.groupBy("stratum", F.col("v.rule").alias("rule"), F.col("v.value").alias("value")).agg(
        F.count_if(~good & proposes).alias("bad"), F.count_if(good & proposes).alias("good"), F.count_if(good & ~proposes).alias("tested")
    )
    rule = Window.partitionBy("stratum", "rule")
    down = rule.orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, 0)
    sums = counts.select(
        "stratum", "rule", "value", (F.col("bad") > 0).alias("candidate"),
        *[F.sum(c).over(down).alias(c) for c in ("bad", "good", "tested")], *[F.sum(c).over(rule).alias(f"all_{c}") for c in ("bad", "good", "tested")],
    )
    candidates = sums.where("candidate and all_tested > 0")
    tests = candidates.agg(F.count_distinct(F.struct("stratum", "rule")).alias("tests"))
    p = F.pandas_udf(_p_values, "double")("tested", "all_tested", F.lit(alpha / len(RULES)))
    worth = F.col("bad") / F.col("all_bad") - PENALTY * F.col("good") / F.greatest("all_good", F.lit(1))
    passed = candidates.withColumns({"p_value": p, "worth": worth}).where("worth > 0").join(tests).where(F.col("p_value") <= delta / F.col("tests"))
    best = F.max_by(F.struct("value", "all_tested", "tested", "p_value"), F.struct(F.round("worth", 9), "value")).alias("b")
    return passed.groupBy("stratum", "rule").agg(best).select("stratum", "rule", F.col("b.value").alias("cutoff"), F.col("b.all_tested").alias("tested"), F.col("b.tested").alias("rejected"), "b.p_value")


def judged_documents(docs: DataFrame, labels: DataFrame, label: str = "quality", stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The counts of every document, whether base rules reject it, and whether a rule of its stratum does.

    The texts are read once; counts are written and joined with the labels by doc_id, then with the table of cutoffs (a few
    rows for each stratum; see ``certified_cutoffs``).

    If a doc_id has several labels the highest counts, and rows that repeat a doc_id share it; a null doc_id has no label.
    Documents without stratum are a stratum. A null or empty text fails the base rules. An empty table gives no rows, and
    without labels only the base rules reject. Further columns are not read.

    Returns doc_id, n_words, word_chars, n_symbols, n_upper, n_lines, n_dup_lines, n_repeat_words, base_failed,
    broken (names of the certified rules that reject it), kept.
    """
    stored = Stored(docs.sparkSession, "rules")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(stratum).cast("string").alias("stratum"), F.col("text").alias("text"))
    facts = stored.save(text_facts(own, ["doc_id", "stratum"]), "facts")
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).alias("label"))
    cutoffs = stored.save(certified_cutoffs(facts.join(known, "doc_id"), alpha, delta), "cutoffs")
    by_stratum = cutoffs.groupBy(F.col("stratum").alias("of")).agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoff"))
    met = facts.join(by_stratum, F.col("stratum").eqNullSafe(F.col("of")), "left")
    broken = F.coalesce(F.transform(F.filter(_values(), lambda v: v["value"] >= F.col("cutoff")[v["rule"]]), lambda v: v["rule"]), F.array().cast("array<string>"))
    out = met.withColumns({"base_failed": base_failed(), "broken": broken}).drop("stratum", "of", "cutoff")
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))
