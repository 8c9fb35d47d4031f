"""Sources mixed to target shares of the tokens (problem 8): raking, then calibrated sampling.

Token weights of (source, language, topic) cells are raked by iterative proportional fitting to three
marginals: the target shares of the sources, and the shares that languages and topics have in the mix's own
texts. The source marginal is fitted last, so it holds; no weight may exceed max_repeats. A cell's weight is
the expected number of uses of each of its texts: the whole part is used for sure, the rest by systematic
sampling with that probability, in order of size. What a source's drawn tokens are still off is evened out
with a few texts used once more or less, so that the amount comes out within a small text.

Shares sum to one, so a source that falls short puts all others above their shares. By default a mix therefore
is as large as its texts, once each, or else as its scarcest source allows at max_repeats: every source that
has texts gets its share. ``total_tokens`` sets another size; then a source that has too little gives all it may.
A text longer than what its source may give at that size isn't used, as one use would overshoot the share.

Scale: texts are read for counting tokens only. The cell table is as long as sources x languages x topics x
classes of size; it is raked by a group for each mix. Sampling runs in windows over small salted groups whose
running totals are offset by those of the groups before, so no source is one task; the salt grows with the source.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siderite.session import small_side, stored

ROUNDS, TOLERANCE = 200, 1e-9
#: Sampling groups of a source: so many for each class, language and topic at least, and so many texts in one at most on average.
SALT, GROUP_TEXTS = 16, 20_000
#: Candidates of each class of size for evening out; what is left to even out is about one text.
CANDIDATES = 16

CELL = ["source", "lang", "topic"]


def size_class(tokens: Column) -> Column:
    """Classes of size that span a factor of the root of two."""
    return F.floor(F.log2(tokens) * 2).cast("int")


def rake(cells: pd.DataFrame, size: float, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of the cells (columns source, lang, topic, tokens, target_share, max_repeats) for ``size`` tokens.

    The weight times the tokens sums to the target of each source that can reach it, and to all it may give
    of each other; languages and topics come as close to their shares as that and max_repeats allow.
    """
    tokens = cells["tokens"].to_numpy(float)
    cap = cells["max_repeats"].to_numpy(float)
    source = pd.factorize(cells["source"])[0]
    can = np.bincount(source, tokens * cap)
    wanted = np.bincount(source, cells["target_share"].to_numpy(float)) / np.maximum(np.bincount(source), 1) * size
    budget = np.minimum(wanted, can)
    own = np.bincount(source, tokens)
    weight = np.minimum((budget / np.maximum(own, 1e-300))[source], cap)
    sides = [(code, np.bincount(code, tokens) / tokens.sum() * budget.sum()) for code in (pd.factorize(cells[k])[0] for k in ("lang", "topic"))]

    def fit_source(w: np.ndarray) -> np.ndarray:
        for _ in range(50):  # what a capped cell can't take goes to the others of its source
            held = np.bincount(source, w * tokens)
            if np.all(np.abs(held - budget) <= 1e-9 * np.maximum(budget, 1)):
                break
            free = w < cap
            loose = np.bincount(source, w * tokens * free)
            factor = np.where(loose > 0, (budget - held + loose) / np.maximum(loose, 1e-300), 1.0)
            w = np.where(free, np.minimum(w * np.maximum(factor, 0)[source], cap), w) if np.any(held < budget) else w * (budget / np.maximum(held, 1e-300))[source]
            w = np.minimum(w, cap)
        return w

    for _ in range(rounds):
        before = weight
        for code, target in sides:
            held = np.bincount(code, weight * tokens)
            weight = np.minimum(weight * np.where(held > 0, target / np.maximum(held, 1e-300), 1.0)[code], cap)
        weight = fit_source(weight)
        if np.max(np.abs(weight - before), initial=0.0) <= TOLERANCE:
            break
    return weight


def mix_size(classes: pd.DataFrame, total: float | None) -> tuple[float, np.ndarray]:
    """(size, usable): the tokens of a mix, and which classes (source, size_class, tokens, longest, target_share, max_repeats) may be used.

    The size is ``total``, else the mix's tokens, or what the scarcest source allows. A class with a text longer than
    what its source gives at that size isn't used; that may leave a source short, but doesn't shrink the mix again.
    """
    source = pd.factorize(classes["source"])[0]
    tokens, cap, longest = (classes[c].to_numpy(float) for c in ("tokens", "max_repeats", "longest"))
    share = np.bincount(source, classes["target_share"].to_numpy(float)) / np.bincount(source)
    size = float(total or tokens.sum())
    can = np.bincount(source, tokens * cap * (longest <= share[source] * size))
    if not total:
        size = min([size, *(can / share)[can > 0]])
    return size, longest <= share[source] * size


def mix_weights(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(mix, source, lang, topic, size_class, weight, budget, max_repeats, texts): expected uses of each text of a cell, tokens and texts of its source.

    sized: mix, doc_id, source, lang, topic, tokens (> 0). targets: as :func:`wishes` gives them. Cells that can't be
    used, and sources without texts, have no row.
    """
    cells = sized.groupBy("mix", *CELL, size_class(F.col("tokens")).alias("size_class")).agg(F.sum("tokens").alias("tokens"), F.max("tokens").alias("longest"), F.count(F.lit(1)).alias("texts"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([*CELL, "size_class"]).reset_index(drop=True)
        size, usable = mix_size(rows, float(total_tokens) if total_tokens else None)
        rows = rows[usable]
        out = ["mix", *CELL, "size_class", "weight", "budget", "max_repeats", "texts"]
        if rows.empty:
            return rows.assign(weight=0.0, budget=0.0)[out]
        whole = rows.groupby(["mix", *CELL], as_index=False).agg(tokens=("tokens", "sum"), target_share=("target_share", "first"), max_repeats=("max_repeats", "first"))
        whole = whole.assign(weight=rake(whole, size))
        whole = whole.assign(budget=(whole["tokens"] * whole["weight"]).groupby(whole["source"]).transform("sum"))
        texts = rows.groupby("source")["texts"].transform("sum")
        return rows.assign(texts=texts).merge(whole[[*CELL, "weight", "budget"]], on=CELL)[out]

    return cells.join(targets, ["mix", "source"]).groupBy("mix").applyInPandas(run, "mix string, source string, lang string, topic string, size_class int, weight double, budget double, max_repeats int, texts bigint")


def wishes(targets: DataFrame) -> DataFrame:
    """(mix, source, target_share, max_repeats): a source that a mix names twice counts with the sum of its shares and the smallest max_repeats."""
    return targets.where("mix IS NOT NULL AND source IS NOT NULL AND target_share > 0 AND max_repeats > 0").groupBy("mix", "source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))


def sample(sized: DataFrame, weights: DataFrame) -> DataFrame:
    """(mix, doc_id, source, tokens, copies, budget, max_repeats): uses of each text, drawn by calibrated probability.

    copies is the whole part of the weight plus, with the fraction as its probability, one. Systematic
    sampling in order of (size class, language, topic, salt, size): the fractions are summed up, and each
    text whose sum passes a whole number is drawn.
    """
    order = ["size_class", "lang", "topic", "salt"]
    salts = F.greatest(F.lit(SALT), F.ceil(F.col("texts") / GROUP_TEXTS))
    keyed = sized.withColumn("size_class", size_class(F.col("tokens")))
    rows = keyed.join(weights, ["mix", *CELL, "size_class"]).select("mix", "doc_id", "source", "lang", "topic", "tokens", "budget", "max_repeats", "size_class", F.floor("weight").alias("sure"), (F.col("weight") - F.floor("weight")).alias("part"), F.pmod(F.xxhash64("doc_id"), salts).alias("salt"))
    rows = stored(rows)
    groups = rows.groupBy("mix", "source", *order).agg(F.sum("part").alias("held"))
    before = F.sum("held").over(Window.partitionBy("mix", "source").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    start = (F.pmod(F.xxhash64("mix", "source"), F.lit(1_000_003)) / 1_000_003.0) + F.coalesce(before, F.lit(0.0))
    offsets = groups.select("mix", "source", *order, start.alias("start"))
    run = F.sum("part").over(Window.partitionBy("mix", "source", *order).orderBy("tokens", F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    summed = rows.withColumn("upto", run).join(offsets, ["mix", "source", *order])
    drawn = F.floor(F.col("start") + F.col("upto") + 1e-9) - F.floor(F.col("start") + F.col("upto") - F.col("part") + 1e-9)
    return summed.select("mix", "doc_id", "source", "tokens", (F.col("sure") + drawn).cast("int").alias("copies"), "budget", "max_repeats")


def even_out(drawn: DataFrame) -> DataFrame:
    """drawn with a few texts of each source used once more, or once less, so that its tokens meet its budget.

    One text of each size class and salt that may change is a candidate, so a source has some hundreds of them
    at most; the largest that fits what is still missing (or too much) is taken, again and again.
    """
    drawn = stored(drawn)
    gap = drawn.groupBy("mix", "source").agg((F.first("budget") - F.sum(F.col("tokens") * F.col("copies"))).alias("gap"))
    near = drawn.join(small_side(stored(gap)), ["mix", "source"])  # one row for each target
    may = F.when(F.col("gap") > 0, F.col("copies") < F.col("max_repeats")).otherwise(F.col("copies") > 0)
    place = Window.partitionBy("mix", "source", "size_class", "salt").orderBy(F.xxhash64("doc_id", "mix"), "doc_id")
    sized = near.where(may & (F.col("tokens") <= F.abs("gap"))).select("mix", "source", "doc_id", "tokens", "gap", size_class(F.col("tokens")).alias("size_class"), F.pmod(F.xxhash64("doc_id"), F.lit(CANDIDATES)).alias("salt"))
    candidates = sized.withColumn("place", F.row_number().over(place)).where("place = 1")

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        left, step, chosen = abs(rows["gap"].iloc[0]), int(np.sign(rows["gap"].iloc[0])), []
        for name, size in rows.sort_values(["tokens", "doc_id"], ascending=False)[["doc_id", "tokens"]].itertuples(index=False):
            if size <= left:
                chosen.append(name)
                left -= size
        return pd.DataFrame({"mix": rows["mix"].iloc[0], "doc_id": chosen, "step": step})

    kind = dict(drawn.dtypes)["doc_id"]
    moved = candidates.groupBy("mix", "source").applyInPandas(choose, f"mix string, doc_id {kind}, step int")
    return drawn.join(moved, ["mix", "doc_id"], "left").withColumn("copies", F.col("copies") + F.coalesce("step", F.lit(0))).drop("step")


def mix(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(mix, doc_id, source, tokens, copies), copies > 0: see :func:`mix_weights`, :func:`sample` and :func:`even_out`.

    Rows without doc_id, source or tokens take no part; missing languages and topics are ``unknown``. Where
    sized has a ``text_key``, equal texts are one text in each mix: the row of the smallest doc_id among the mix's own
    sources stands for all, so that max_repeats holds for the text and not for each time it was fetched.
    """
    usable = sized.where("doc_id IS NOT NULL AND source IS NOT NULL AND tokens > 0")
    named = lambda c: F.coalesce(c, F.lit("unknown")).alias(c)
    keys = [c for c in ("text_key",) if c in sized.columns]
    wanted = stored(wishes(targets))
    own = usable.select("doc_id", "source", named("lang"), named("topic"), "tokens", *keys).join(small_side(wanted.select("mix", "source")), "source")
    if keys:
        first = F.min(F.struct("doc_id", "source", "lang", "topic", "tokens")).alias("x")
        own = own.groupBy("mix", "text_key").agg(first).select("mix", "x.*")
    own = stored(own.select("mix", "doc_id", *CELL, "tokens"))
    drawn = even_out(sample(own, mix_weights(own, wanted, total_tokens)))
    return drawn.where("copies > 0").select("mix", "doc_id", "source", "tokens", "copies")


def share_report(selection: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix, source, target_share, reached_share, tokens, texts, most_copies) for every target, also of sources without texts."""
    used = selection.groupBy("mix", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("texts"), F.max("copies").alias("most_copies"))
    totals = used.groupBy("mix").agg(F.sum("tokens").alias("total"))
    wishes = targets.groupBy("mix", "source").agg(F.sum("target_share").alias("target_share"))
    joined = wishes.join(used, ["mix", "source"], "left").join(totals, "mix", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return joined.select("mix", "source", "target_share", F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)).alias("reached_share"), zero("tokens"), zero("texts"), zero("most_copies"))


def mix_faults(selection: DataFrame, targets: DataFrame, sized: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """(mix, sources, strangers, repeated, texts_twice, off_share): how often a selection breaks its rules.

    strangers: selected texts of sources that the mix doesn't name; repeated: texts used more often than max_repeats;
    texts_twice: equal texts under two doc_ids; off_share: sources with texts whose tokens are off
    by more than ``tolerance`` of the mix's and by more than a text of theirs. sized: doc_id, source, text_key, tokens.
    """
    wanted = wishes(targets)
    total = selection.groupBy("mix").agg(F.sum(F.col("tokens") * F.col("copies")).alias("total"))
    beside = selection.join(wanted, ["mix", "source"], "left").join(sized.select("doc_id", "text_key"), "doc_id")
    rows = beside.groupBy("mix").agg(F.count_if(F.col("target_share").isNull()).alias("strangers"), F.count_if(F.col("copies") > F.col("max_repeats")).alias("repeated"))
    twice = beside.groupBy("mix", "text_key").agg(F.count(F.lit(1)).alias("n")).groupBy("mix").agg(F.count_if(F.col("n") > 1).alias("texts_twice"))
    held = selection.groupBy("mix", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("held"), F.max("tokens").alias("longest"))
    known = wanted.join(sized.where("tokens > 0").groupBy("source").agg(F.min("tokens").alias("shortest")), "source")
    here = known.groupBy("mix").agg(F.sum("target_share").alias("reachable"))
    shares = known.join(held, ["mix", "source"], "left").join(total, "mix", "left").join(here, "mix")
    off = F.abs(F.coalesce("held", F.lit(0)) - F.col("total") * F.col("target_share") / F.col("reachable")) > F.greatest(F.col("total") * tolerance, F.coalesce("longest", F.lit(0)), F.col("shortest"))
    near = shares.groupBy("mix").agg(F.count_if(F.coalesce(off, F.lit(True))).alias("off_share"))
    named = wanted.groupBy("mix").agg(F.count(F.lit(1)).alias("sources"))
    joined = named.join(rows, "mix", "left").join(twice, "mix", "left").join(near, "mix", "left")
    return joined.select("mix", "sources", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("strangers", "repeated", "texts_twice", "off_share")])
