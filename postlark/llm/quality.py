"""Quality rules with risk-controlled thresholds.

Per text, DataFrame functions compute counts: words, their characters, symbols, repeated lines, words in repeated 8-word
windows. Four ratios of these, all "higher is worse", get cutoffs per stratum (a band of text length), decided by a labelled
holdout of good documents (``quality`` = 1). All four tighten together along one path fixed in advance (``PATH``, ``STEPS``).
A step is admitted if the exact binomial test rejects "the rules at this step turn away ``ALPHA`` of the good documents or
more", counting a document that any of them turns away; the path is walked from lenient to strict and stops at the first
failure (fixed-sequence testing), so a stratum costs one error however many rules and steps there are. Each walk gets
``DELTA`` / strata. With confidence 1 - ``DELTA`` no stratum loses more than ``ALPHA`` of its good documents.

Bands with too few good documents for any step to pass are joined with the next longer one (the last with the one before),
so a stratum without cutoffs is left only where all bands together are too few (``enough``: 217 at the defaults, 149 if
one stratum is left). Joining looks at numbers of good documents alone, not at their ratios, and the path at no label, so
labels are used for nothing but the test. What reaches the driver is strata x (steps + 1) counts, whatever the corpus.

Cases: null and empty texts have no words and fail the base rule; without enough labels there is no cutoff and the method
keeps all; labels with a null id or quality are ignored; several labels of one id count once, the lowest quality deciding; the
input's rows are kept one for one; of clashing column names the operator's win.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlark.operators.spread import cut, settled

ALPHA = 0.02
DELTA = 0.05
BANDS = (100, 500, 2000)
WINDOW = 8
MIN_WORDS = 20
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
RATIOS = {
    "symbol_ratio": "n_symbols / greatest(n_words, 1)",
    "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_ratio": "n_repeat_words / greatest(n_words, 1)",
    "upper_ratio": "n_upper / greatest(word_chars, 1)",
}
# Where each ratio's cutoff begins and ends; between them it falls by equal factors.
PATH = {"symbol_ratio": (1.0, 0.01), "dup_line_ratio": (0.9, 0.1), "repeat_ratio": (0.3, 0.05), "upper_ratio": (0.9, 0.1)}
STEPS = 60
GRID = {name: tuple(round(a * (b / a) ** (k / (STEPS - 1)), 4) for k in range(STEPS)) for name, (a, b) in PATH.items()}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]


def _repeated_places(sorted_windows: Column) -> Column:
    """Places of the windows whose neighbour in hash order has the same hash."""
    at = lambda j: F.get(sorted_windows, j)["h"]
    twice = F.filter(sorted_windows, lambda x, j: (x["h"] == at(j - 1)) | (x["h"] == at(j + 1)))
    return F.sort_array(F.transform(twice, lambda x: x["i"]))


def _covered(places: Column) -> Column:
    """Words covered by the windows at ascending places."""
    first = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    add = lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last"))
    return F.aggregate(places, first, add, lambda a: a["n"])


def text_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the counts of each whole text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    drop = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    out = settled(docs.drop(*COUNTS), {"_hash": F.transform(words, lambda w: F.xxhash64(w))})
    last = F.size("_hash") - WINDOW
    window = lambda i: F.xxhash64(*[F.get(F.col("_hash"), i + k) for k in range(WINDOW)])
    windows = F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), window)).otherwise(F.array().cast("array<bigint>"))
    out = settled(out, {"n_words": F.size("_hash").cast("long"), "_windows": windows}).drop("_hash")
    pairs = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = F.size(F.array_distinct("_windows")) < F.size("_windows")
    lines = F.filter(F.split(text, "\n"), lambda s: F.length(F.translate(s, SPACES, "")) > 0)
    out = settled(out, {"_pairs": F.when(twice, pairs).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")), "_lines": lines})
    return out.withColumns(
        {
            "word_chars": F.length(F.translate(text, SPACES, "")).cast("long"),
            "n_symbols": drop(SYMBOLS).cast("long"),
            "n_upper": drop(upper).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": _covered(_repeated_places(F.col("_pairs"))).cast("long"),
        }
    ).drop("_windows", "_pairs", "_lines")


def stratum() -> Column:
    """Band of text length, a property of the text alone."""
    return sum((F.col("n_words") >= b).cast("int") for b in BANDS)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for n trials of probability p, summed from the last term down; 1, an upper bound, beyond the mean."""
    if k > n * p:
        return 1.0
    log = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    total, i, term = 0.0, k, math.exp(log)
    while i >= 0 and term > total * 1e-17:
        total += term
        term *= i * (1 - p) / ((n - i + 1) * p)
        i -= 1
    return min(1.0, total)


def enough(alpha: float, delta: float) -> int:
    """Good documents a stratum needs: with fewer, not even a step that turns none away passes."""
    return math.ceil(math.log(delta) / math.log1p(-alpha))


def strata(good: list[int], least: int) -> list[int]:
    """The stratum of each band: bands are joined from the shortest on until each stratum has ``least`` good documents."""
    out, held = [0], good[0]
    for n in good[1:]:
        full = held >= least
        out.append(out[-1] + full)
        held = n if full else held + n
    return out if held >= least else [min(s, max(out[-1] - 1, 0)) for s in out]


def admitted(by_first: list[int], alpha: float, delta: float) -> int | None:
    """The strictest step reached by a walk; ``by_first[k]`` good documents are turned away from step k on, the last never."""
    rejected, reached = 0, None
    for k, more in enumerate(by_first[:-1]):
        rejected += more
        if binomial_tail(rejected, sum(by_first), alpha) > delta:
            break
        reached = k
    return reached


def _steps_exceeded(ratio: Column, limits: tuple[float, ...]) -> Column:
    return F.size(F.filter(F.array(*[F.lit(c) for c in limits]), lambda c: ratio > c))


def cutoffs(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", alpha: float = ALPHA, delta: float = DELTA) -> list[dict[str, float]]:
    """For each band of length the cutoffs by ratio, from the labelled good documents; empty without an admitted step."""
    good = (
        labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull())
        .groupBy(id_col).agg(F.min("quality").alias("quality")).where("quality = 1").select(id_col)
    )
    over = [_steps_exceeded(F.expr(r).cast("double"), GRID[name]) for name, r in RATIOS.items()]
    table = (
        measured.where(f"n_words >= {MIN_WORDS} and 100 * n_repeat_words <= 30 * n_words")
        .join(good, id_col, "left_semi")
        .groupBy(stratum().alias("band"), (STEPS - F.greatest(*over)).alias("first")).count()
        .collect()
    )
    counts = [[0] * (STEPS + 1) for _ in range(len(BANDS) + 1)]
    for row in table:
        counts[row["band"]][row["first"]] += row["count"]
    of = strata([sum(c) for c in counts], enough(alpha, delta / len(counts)))
    reached = [
        admitted([sum(c) for c in zip(*(counts[b] for b, t in enumerate(of) if t == s))], alpha, delta / (of[-1] + 1)) for s in range(of[-1] + 1)
    ]
    return [{} if reached[s] is None else {name: GRID[name][reached[s]] for name in RATIOS} for s in of]


def judge_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, delta: float = DELTA
) -> DataFrame:
    """All columns but the text, with counts, ``base_failed``, the first ratio over its cutoff (``rejected_by``) and ``kept``."""
    counted = cut(text_counts(docs, text_col).drop(text_col, "base_failed", "rejected_by", "kept"))
    found = cutoffs(counted, labels, id_col, alpha, delta)
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    reasons = [
        F.when((stratum() == band) & (F.expr(RATIOS[name]) > limit), F.lit(name)) for band, by_name in enumerate(found) for name, limit in by_name.items()
    ]
    out = counted.withColumn("base_failed", base).withColumn("rejected_by", F.coalesce(*reasons) if reasons else F.lit(None).cast("string"))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull())
