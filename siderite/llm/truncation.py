"""Texts that were cut off before their end (problem 9).

Near-copies come first: every two texts of different length whose five-word shingles have a Jaccard similarity of
0.8 or more are found by an exact join (prefix filter), the similarity is verified on the texts, and the shorter
text's closing shingle is looked for in the longer one. Where words follow it there, the copy ended early. Edits
elsewhere in the texts don't matter.

Every other text is scored by the terminality of its closing words: how often they end a text, over how often
they occur at all, a longer word that begins like the closing one counting as an occurrence that went on. The
rate is smoothed from the place in the line over the line before, the word and its place, two words, to three,
each text leaving itself out. An open tag, an open entity or a broken character at the end is a cut by itself.
No length of text, line or word decides anything.

Scale: each different text moves once, when exact copies are dropped after map-side combine; all counts run over
the stored table of different texts, so copies weigh nothing. A score belongs to a closing, not to a text, so a
closing that a third of all texts share is scored once. Texts that differ in numbers, case and marks only are one
form; forms meet by their rarest shingles, and only hashes move before a pair is verified. The pairs to look at grow
with how many texts share their rarest shingles: where more texts only repeat the same wording, with the square of
them. No cap on anything.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siderite.session import stored

SHINGLE_WORDS, SIMILARITY = 5, 0.8
#: What two texts of that similarity share of their added sizes, at least; what float products may be off by.
OVERLAP, ROUNDING = SIMILARITY / (1 + SIMILARITY), 1e-9
#: Shingles are taken from the rarest on; how many texts tell which are common, and how many hold a common one.
ORDER_TEXTS, COMMON = 20_000, 3
#: Sizes are told apart in spans of this ratio, a little over 1 / SIMILARITY. Bits of a text's shape.
SPAN_RATIO, BITS = 1.26, 256
#: A closing without a sentence mark is a cut below this rate; one with a mark below the other.
OPEN_RATE, MARKED_RATE = 0.03, 0.003
#: How many occurrences the coarser rate counts as, without and with a sentence mark.
OPEN_PRIOR, MARKED_PRIOR = 5.0, 200.0
#: Places in a line are told apart up to this one; later ones are alike.
LATE_PLACE = 12

_QUOTES = r"[\"'”’»)\]]*"
#: What stands for the words before a line's first.
_START = "⏎"


def _folded(text: Column) -> Column:
    """Lower case, each number a 0."""
    return F.regexp_replace(F.lower(text), r"\d+(?:[.,]\d+)*", "0")


def usable_texts(documents: DataFrame) -> DataFrame:
    """(doc_id, source, text_key, text): documents with an id and more than blanks; text without blanks at its end."""
    text = F.regexp_replace("text", r"\s+$", "")
    return documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "source", text.alias("text")).where("text <> ''").select("doc_id", "source", F.md5("text").alias("text_key"), "text")


def different_texts(texts: DataFrame) -> DataFrame:
    """(text_key, text), one row for each different text however many copies it has."""
    return texts.select("text_key", "text").dropDuplicates(["text_key"])


def marked_lines(texts: DataFrame) -> DataFrame:
    """(text_key, broken, lines): each line as words parted by one blank, a word with the mark that follows it.

    ``.`` stands for any sentence mark, ``…`` for any ellipsis, any other mark for itself; a word without one
    has none. Lines without words are gone. broken: an open tag or entity or a broken character at the end.
    """
    broken = F.col("text").rlike(r"(?:<[a-zA-Z/!][^<>]*|&#?[a-zA-Z0-9]*|\x{FFFD})$")
    rows = texts.select("text_key", broken.alias("broken"), _folded(F.col("text")).alias("t"))
    steps = [
        (rf"\s*(?:\[\.\.\.\]|\.\.+|…){_QUOTES}(?=\s|$)", "… "),
        (rf"\s*[.!?]{_QUOTES}(?=\s|$)", ". "),
        (r"([\p{L}\p{N}])[ \t]*([^\p{L}\p{N}\s….])[^\p{L}\p{N}\n….]*", "$1$2 "),
        (r"\.(?=[\p{L}\p{N}])", ". "),
        (r"(^|\s)[^\p{L}\p{N}\s]+", "$1"),
        (r"[^\S\n]+", " "),
    ]
    for i in range(0, len(steps), 2):  # a column for every two steps, so that no plan nests them all
        tidy = F.col("t")
        for pattern, into in steps[i : i + 2]:
            tidy = F.regexp_replace(tidy, pattern, into)
        rows = rows.withColumn("t", tidy)
    lines = F.filter(F.transform(F.split("t", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return rows.select("text_key", "broken", lines.alias("lines"))


def _bare(line: Column) -> Column:
    """A marked line's words without their marks."""
    return F.split(F.regexp_replace(line, r"[^\p{L}\p{N} ]", ""), " ")


def _before(line: Column) -> Column:
    """The last two words of a line, marks included, as a hash; one for no line."""
    return F.xxhash64(F.regexp_extract(F.coalesce(line, F.lit("")), r"(?:\S+ )?\S*$", 0))


def closings(lines: DataFrame) -> DataFrame:
    """(text_key, broken, closing, kind, place, before, c2, c3, word): how each text closes; ``closing`` hashes the rest.

    kind: ``.`` sentence mark, ``…`` ellipsis, '' none, else the mark; place of the word in its line; before, c2
    and c3 hash the line before and the one and two words before. Texts without a word have a null closing.
    """
    rows = lines.select("text_key", "broken", F.try_element_at("lines", F.lit(-1)).alias("last"), F.try_element_at("lines", F.lit(-2)).alias("previous"))
    rows = rows.select("*", F.regexp_extract("last", r"[^\p{L}\p{N}]$", 0).alias("kind"), _bare(F.col("last")).alias("w"))
    at = lambda back: F.coalesce(F.get("w", F.size("w") - back), F.lit(_START))
    rows = rows.select("text_key", "broken", "kind", F.least(F.size("w"), F.lit(LATE_PLACE)).cast("bigint").alias("place"), _before(F.col("previous")).alias("before"), F.xxhash64(at(2)).alias("c2"), F.xxhash64(at(3), at(2)).alias("c3"), F.when(F.col("last").isNotNull(), at(1)).alias("word"))
    return rows.withColumn("closing", F.when(F.col("word").isNotNull(), F.xxhash64("kind", "place", "before", "c2", "c3", "word")))


def word_counts(lines: DataFrame) -> DataFrame:
    """(level, context, word, n, marked): occurrences of words after their contexts in all lines of all texts.

    Levels: 1 a place after a line (word ''), 2 a word at a place, 3 after a word, 4 after two words. ``marked``
    of the n are followed by a sentence mark.
    """
    # the line before comes along as a hash, so that no line moves twice
    befores = F.concat(F.array(_before(F.lit(""))), F.transform("lines", lambda x: _before(x)))
    each = lines.select(F.explode(F.arrays_zip(F.col("lines").alias("line"), F.slice(befores, 1, F.greatest(F.size("lines"), F.lit(0))).alias("before"))).alias("x")).select("x.line", "x.before")
    each = each.select("before", F.split("line", " ").alias("t"), _bare(F.col("line")).alias("w"))
    places = each.groupBy("before", F.least(F.size("w"), F.lit(LATE_PLACE)).alias("size"), (F.size("w") - LATE_PLACE).alias("late")).agg(F.count(F.lit(1)).alias("lines"))
    # a line has each place up to its own size once, and the late one as often as it has late words
    reached = places.select("before", "lines", "late", F.explode(F.sequence(F.lit(1), "size")).alias("place"))
    counted = F.when(F.col("place") == LATE_PLACE, F.col("lines") * (F.col("late") + 1)).otherwise(F.col("lines"))
    by_line = reached.groupBy(F.xxhash64("before", F.col("place").cast("bigint")).alias("context")).agg(F.sum(counted).alias("n"))
    starts = lambda k: F.concat(F.array_repeat(F.lit(_START), k), "w")
    zipped = F.arrays_zip(F.col("t"), F.col("w"), F.slice(starts(1), 1, F.size("w")).alias("w2"), F.slice(starts(2), 1, F.size("w")).alias("w3"))
    words = each.select(F.posexplode(zipped).alias("at", "x")).select(F.least(F.col("at") + 1, F.lit(LATE_PLACE)).cast("bigint").alias("place"), F.col("x.w").alias("word"), F.xxhash64("x.w2").alias("c2"), F.xxhash64("x.w3", "x.w2").alias("c3"), F.endswith("x.t", F.lit(".")).alias("m"))
    once = words.groupBy("c3", "c2", "place", "word").agg(F.count(F.lit(1)).alias("n"), F.count_if("m").alias("marked"))
    levels = F.array(*[F.struct(F.lit(k).alias("level"), F.col(c).alias("context")) for k, c in ((2, "place"), (3, "c2"), (4, "c3"))])
    by_word = once.select(F.explode(levels).alias("x"), "word", "n", "marked").groupBy("x.level", "x.context", "word").agg(F.sum("n").alias("n"), F.sum("marked").alias("marked"))
    return by_word.unionByName(by_line.select(F.lit(1).alias("level"), "context", F.lit("").alias("word"), "n", F.lit(0).cast("bigint").alias("marked")))


def closing_rates(lines: DataFrame, ends: DataFrame) -> DataFrame:
    """(closing, kind, rate): how often a text ends where it closes like that, from counts over all texts.

    A closing without a sentence mark is held against all occurrences of its words, whatever follows them, one
    with a mark against those before a mark.
    """
    counts = stored(word_counts(lines))
    shapes = stored(ends.where("closing IS NOT NULL").groupBy("closing", "kind", "place", "before", "c2", "c3", "word").agg(F.count(F.lit(1)).alias("texts")))
    keyed = F.array(
        F.struct(F.lit(1).alias("level"), F.xxhash64("before", "place").alias("context"), F.lit("").alias("word")),
        *[F.struct(F.lit(k).alias("level"), F.col(c).alias("context"), F.col("word").alias("word")) for k, c in ((2, "place"), (3, "c2"), (4, "c3"))],
    )
    long = shapes.select("closing", "kind", "texts", F.explode(keyed).alias("x")).select("closing", "kind", "texts", "x.*")
    key = ["level", "context", "word"]
    ended = long.groupBy(*key, "kind").agg(F.sum("texts").alias("ends"))
    # a word that goes on where this one ends: every beginning of every counted word, looked up among the closings
    wanted = long.where("level > 1 AND kind IN ('', '…')").select(*key).distinct()
    begun = counts.where("level > 1 AND length(word) > 1").select("level", "context", "n", "word", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("upto"))
    longer = begun.select("level", "context", "n", F.expr("substring(word, 1, upto)").alias("word")).join(wanted, key, "left_semi").groupBy(*key).agg(F.sum("n").alias("longer"))
    known = ended.join(counts, key, "left").join(longer, key, "left").select(*key, "kind", "ends", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("marked", F.lit(0)).alias("marked"), F.when(F.col("kind").isin("", "…"), F.coalesce("longer", F.lit(0))).otherwise(0).alias("longer"))
    one = known.select(*key, "kind", F.struct("ends", "n", "marked", "longer").alias("c"))
    gathered = long.join(one, [*key, "kind"]).groupBy("closing", "kind").agg(F.map_from_entries(F.collect_list(F.struct("level", "c"))).alias("c"))  # four entries each
    # the coarsest rates: of each place without a mark, and of all sentence marks
    places = counts.where("level = 2").groupBy(F.col("context").alias("place")).agg(F.sum("n").alias("n0"))
    open_ends = shapes.where("kind <> '.'").groupBy("place").agg(F.sum("texts").alias("e0"))
    coarse = shapes.select("closing", "kind", "place").join(places, "place", "left").join(open_ends, "place", "left").select("closing", "kind", "n0", F.coalesce("e0", F.lit(1)).alias("e0"))
    rows = gathered.join(coarse, ["closing", "kind"])
    all_marked = counts.where("level = 2").agg(F.sum("marked").alias("n")).first()["n"] or 1
    all_ends = shapes.where("kind = '.'").agg(F.sum("texts").alias("n")).first()["n"] or 0
    rate = (F.col("e0") - 1) / F.greatest(F.col("n0") - 1, F.lit(1))
    marked = F.lit(all_ends / all_marked)
    for k in (1, 2, 3, 4):
        c = F.col("c")[k]
        rate = (c["ends"] - 1 + OPEN_PRIOR * rate) / (F.greatest(c["n"] - 1, F.lit(0)) + c["longer"] + OPEN_PRIOR)
        if k in (2, 3):
            marked = (c["ends"] - 1 + MARKED_PRIOR * marked) / (F.greatest(c["marked"] - 1, F.lit(0)) + MARKED_PRIOR)
    return rows.select("closing", "kind", F.when(F.col("kind") == ".", marked).otherwise(rate).alias("rate"))


def _items(text: str) -> tuple[list[str], list[str]]:
    """(words, what follows each up to the next)."""
    import regex

    parts = regex.findall(r"([\p{L}\p{N}]+)([^\p{L}\p{N}]*)", text)
    return [w.lower() for w, _ in parts], [s for _, s in parts]


def _shingle_hashes(batch: pa.RecordBatch, known: dict[str, int]) -> Iterator[tuple[str, int, int, np.ndarray]]:
    """(text_key, words, form, different shingles as hashes) of the texts of more than SHINGLE_WORDS words.

    The shingles' words are those of _items, each number a 0; ``form`` hashes them all and ``words``, which counts a
    number with its decimals as one. known: the words' codes so far.
    """
    import regex

    find, decimals = regex.compile(r"[\p{L}\p{N}]+").findall, regex.compile(r"(?<=[0-9])[.,](?=[0-9])").findall
    code = lambda w: xxhash.xxh64_intdigest("0" if w.isdigit() else w)
    for key, text in zip(batch["text_key"].to_pylist(), batch["text"].to_pylist()):
        words = find(text)
        if len(words) <= SHINGLE_WORDS:
            continue
        if len(known) > 1_000_000:
            known.clear()
        codes = np.fromiter((known.get(w) or known.setdefault(w, code(w.lower())) for w in words), np.uint64, len(words))
        shingle = np.zeros(len(words) - SHINGLE_WORDS + 1, np.uint64)
        for i in range(SHINGLE_WORDS):
            shingle = (shingle ^ codes[i : i + shingle.size]) * np.uint64(0x9E3779B97F4A7C15)
            shingle ^= shingle >> np.uint64(29)
        count = len(words) - len(decimals(text))
        yield key, count, xxhash.xxh64_intdigest(codes.tobytes(), count), np.unique(shingle)


def common_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, counts) of the shingles that COMMON or more of about ORDER_TEXTS texts hold.

    They only decide in which order text_shapes takes shingles, so how much near_copies has to look at: the pairs
    it finds are the same with any order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            if held := [x for _, _, _, x in _shingle_hashes(batch, known)]:
                hashes, n = np.unique(np.concatenate(held), return_counts=True)
                yield pa.RecordBatch.from_pydict({"shingle": pa.array(hashes.view(np.int64)), "n": pa.array(n, pa.int64())})

    parts = 1 << 20
    share = min(1.0, ORDER_TEXTS / max(1, texts.count()))
    some = texts.where(F.pmod(F.xxhash64("text_key"), F.lit(parts)) < share * parts).select("text_key", "text")
    rows = some.mapInArrow(run, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON).toArrow()
    hashes, counts = rows["shingle"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def _folded_bits(odd: np.ndarray, size: int) -> np.ndarray:
    """The marks as they are in ``size`` bytes; both sizes are powers of two."""
    return np.bitwise_xor.reduce(odd.reshape(-1, size), axis=0)


def text_shapes(texts: DataFrame) -> DataFrame:
    """(text_key, form, words, size, few, first, bits, marks) of the texts of more than SHINGLE_WORDS words.

    form: the same for texts that differ in case, marks, blanks and numbers only; size: how many different shingles.
    first: the rarest shingles, as many as make sure that a text of similarity SIMILARITY has one of them among its
    own, ``few`` of them if it is no smaller. bits: of BITS, those that an odd number of shingles fall on; marks: the
    same of twice the size or more.
    """
    common, counts = common_shingles(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            rows = list(_shingle_hashes(batch, known))
            if not rows:
                continue
            first, few, bits, marks = [], [], [], []
            for _, _, _, x in rows:
                held = np.zeros(x.size, np.int64)
                if common.size:
                    at = np.minimum(np.searchsorted(common, x), common.size - 1)
                    held = np.where(common[at] == x, counts[at], 0)
                first.append(x[np.lexsort((x, held))[: x.size - math.ceil(SIMILARITY * x.size - ROUNDING) + 1]])
                few.append(x.size - math.ceil(2 * OVERLAP * x.size - ROUNDING) + 1)
                wide = max(BITS, 1 << (2 * x.size - 1).bit_length())
                odd = np.packbits((np.bincount((x >> np.uint64(32)).astype(np.int64) % wide, minlength=wide) & 1).astype(np.uint8))
                bits.append(_folded_bits(odd, BITS // 8).view(np.int64))
                marks.append(odd.tobytes())
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]), pa.int32()), pa.array(np.concatenate(x).view(np.int64)))
            forms = pa.array(np.array([form for _, _, form, _ in rows], np.uint64).view(np.int64))
            ints = lambda x: pa.array(x, pa.int32())
            yield pa.RecordBatch.from_pydict({"text_key": pa.array([k for k, *_ in rows], pa.string()), "form": forms, "words": ints([n for _, n, _, _ in rows]), "size": ints([x.size for *_, x in rows]), "few": ints(few), "first": lists(first), "bits": lists(bits), "marks": pa.array(marks, pa.binary())})

    return texts.select("text_key", "text").mapInArrow(run, "text_key string, form bigint, words int, size int, few int, first array<bigint>, bits array<bigint>, marks binary")


def near_copies(shapes: DataFrame) -> DataFrame:
    """(short, long): forms of different length, among them every two whose similarity is SIMILARITY or more.

    Two forms of that similarity share OVERLAP of their added sizes or more, so one of the rarest ``few`` of the
    smaller is among the rarest ``first`` of the larger, at a place that leaves as many after it; and no more bits
    differ than shingles. Both hold for every such pair, so none is lost; what is left over is told by the texts. Few
    bits tell long texts apart badly, so their marks are compared, too.
    """
    forms = stored(shapes.drop("text_key").dropDuplicates(["form"]).withColumn("span", F.floor(F.log("size") / float(np.log(SPAN_RATIO))).cast("int")))
    word_bits = [f"b{k}" for k in range(BITS // 64)]
    shape = ["form", "words", "size", *[F.col("bits")[k].alias(b) for k, b in enumerate(word_bits)]]
    larger = forms.select(*shape, "span", F.posexplode("first").alias("at", "shingle"))
    # a form of the similarity is at most 1.25 times as large, so it is in the same span of sizes or the next
    smaller = forms.select(*shape, F.explode(F.array("span", F.col("span") + 1)).alias("span"), F.slice("first", F.lit(1), F.col("few")).alias("first"))
    smaller = smaller.select("form", "words", "size", *word_bits, "span", F.posexplode("first").alias("at", "shingle"))
    a, b = smaller.alias("a"), larger.alias("b")
    both = F.col("a.size") + F.col("b.size")
    ordered = (F.col("a.size") < F.col("b.size")) | ((F.col("a.size") == F.col("b.size")) & (F.col("a.form") < F.col("b.form")))
    enough = F.least(F.col("a.size") - F.col("a.at"), F.col("b.size") - F.col("b.at")) >= OVERLAP * both - ROUNDING
    differ = sum((F.bit_count(F.col(f"a.{k}").bitwiseXOR(F.col(f"b.{k}"))) for k in word_bits[1:]), F.bit_count(F.col("a.b0").bitwiseXOR(F.col("b.b0"))))
    alike = differ <= (1 - 2 * OVERLAP) * both + ROUNDING
    met = a.join(b, (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.span") == F.col("b.span")) & (F.col("a.words") != F.col("b.words")) & ordered & enough & alike)
    first = F.col("a.words") < F.col("b.words")
    found = met.select(F.when(first, F.col("a.form")).otherwise(F.col("b.form")).alias("short"), F.when(first, F.col("b.form")).otherwise(F.col("a.form")).alias("long")).distinct()
    found = stored(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for x, m, y, n in zip(*(batch[c].to_pylist() for c in ("x", "m", "y", "n"))):
                u, v = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                size = min(u.size, v.size)
                differ = int(np.bitwise_count(_folded_bits(u, size) ^ _folded_bits(v, size)).sum())
                kept.append(differ <= (1 - 2 * OVERLAP) * (m + n) + ROUNDING)
            yield batch.select(["short", "long"]).filter(pa.array(kept, pa.bool_()))

    marked = stored(forms.select("form", "size", "marks").join(found.select(F.explode(F.array("short", "long")).alias("form")).distinct(), "form", "left_semi"))
    read = lambda key, marks, size: marked.select(F.col("form").alias(key), F.col("marks").alias(marks), F.col("size").alias(size))
    return found.join(read("short", "x", "m"), "short").join(read("long", "y", "n"), "long").select("short", "long", "x", "m", "y", "n").mapInArrow(run, "short bigint, long bigint")


def _grams(words: list[str]) -> list[tuple[str, ...]]:
    """The shingles of a text's words, each number a 0; the words themselves if they are fewer."""
    folded = ["0" if w.isdigit() else w for w in words]
    return [tuple(folded[i : i + SHINGLE_WORDS]) for i in range(max(1, len(folded) - SHINGLE_WORDS + 1))]


def _aligned_place(x: list[tuple[str, ...]], y: list[tuple[str, ...]]) -> tuple[float, int | None, int | None]:
    """(similarity, back, at) of a short text's shingles in a long one's: ``back`` 1 or more words from its end they meet, its last word stands at ``at``.

    The last shingle of whole words that ``y`` has, too, at the occurrence nearest to its own place, anchors the end.
    """
    sx, sy = set(x), set(y)
    similarity = len(sx & sy) / max(1, len(sx | sy))
    if similarity < SIMILARITY or len(x) < 2:
        return similarity, None, None
    for back in range(1, SHINGLE_WORDS + 1):  # the last word may be a fragment, the ones before it may be edited
        i = len(x) - 1 - back
        if i >= 0 and x[i] in sy:
            at = min((p for p, g in enumerate(y) if g == x[i]), key=lambda p: abs(p - i))
            return similarity, back, at + SHINGLE_WORDS + back - 1
    return similarity, None, None


def _ending(words: list[str], after: list[str]) -> tuple[str, bool, bool]:
    """(last word, whether nothing but blanks follows it, whether it ends a sentence)."""
    import regex

    tail = after[-1]
    return words[-1], tail.strip() == "", regex.search(r"(?:\.\.|…|\[\.\.\.\])", tail) is None and regex.search(r"[.!?]", tail) is not None


def _going_on(words: list[str], after: list[str], at: int) -> tuple[str | None, str]:
    """(the word at ``at``, null beyond the end; how the text goes on behind it: ``ends`` with a line, in a ``number``, or with ``words``)."""
    if at >= len(words):
        return None, "ends"
    if at + 1 >= len(words) or "\n" in after[at]:
        return words[at], "ends"
    if words[at].isdigit() and words[at + 1].isdigit() and after[at] in (".", ","):
        return words[at], "number"
    return words[at], "words"


def aligned_end(short: str, long: str) -> tuple[float, bool | None]:
    """(similarity, cut): Jaccard similarity of the texts' word shingles, and whether ``short`` ended early inside a word or sentence.

    cut is null where the closing words of ``short`` are nowhere in ``long``, or another word than its last stands
    there after other words. Linear in the texts. aligned_cuts does the same for all texts by joins.
    """
    (x, after_x), (y, after_y) = _items(short), _items(long)
    similarity, back, at = _aligned_place(_grams(x), _grams(y))
    if back is None:
        return similarity, None
    (last, blank, stops), (word, how) = _ending(x, after_x), _going_on(y, after_y, at)
    if word is None:
        return similarity, False
    if word != last:
        return similarity, word.startswith(last) and blank if back == 1 else None
    return similarity, how == "number" or how == "words" and not stops


def aligned_cuts(texts: DataFrame) -> DataFrame:
    """(text_key, cut_inside): texts with a longer near-copy that has their end; whether they stop inside a word or sentence there.

    Longer means more words. Every near-copy counts; one in which a text is cut decides. Only hashes move; the texts
    of the pairs are fetched by key. Similarity and place rest on the forms alone and are found once for two forms;
    the texts of a form then meet by their last words and by the words that stand there, not one by one.
    """
    shapes = stored(text_shapes(texts))
    met = stored(near_copies(shapes))
    named = shapes.select("form", "text_key")
    wanted = stored(met.select(F.explode(F.array("short", "long")).alias("form")).distinct())
    heads = named.join(wanted, "form", "left_semi").groupBy("form").agg(F.min("text_key").alias("text_key"))
    found_texts = stored(texts.select("text_key", "text").join(heads, "text_key").select("form", "text"))
    read = lambda key, out: found_texts.select(F.col("form").alias(key), F.col("text").alias(out))
    pairs = met.join(read("short", "a"), "short").join(read("long", "b"), "long").select("short", "long", "a", "b")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = lru_cache(256)(lambda text: _grams(_items(text)[0]))
        for batch in batches:
            placed = [_aligned_place(grams(a), grams(b)) for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch["short"], batch["long"], pa.array([p for _, p, _ in placed], pa.int32()), pa.array([p for _, _, p in placed], pa.int32())], ["short", "long", "back", "at"])

    def ending(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [_ending(*_items(t)) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["short"], batch["text_key"], pa.array([w for w, _, _ in ends], pa.string()), pa.array([b for _, b, _ in ends], pa.bool_()), pa.array([s for *_, s in ends], pa.bool_())], ["short", "text_key", "word", "blank", "stops"])

    def going_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_going_on(*_items(t), at) for t, at in zip(batch["text"].to_pylist(), batch["at"].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch["long"], batch["at"], pa.array([w for w, _ in found], pa.string()), pa.array([h for _, h in found], pa.string())], ["long", "at", "word", "how"])

    placed = stored(pairs.mapInArrow(place, "short bigint, long bigint, back int, at int").where("back IS NOT NULL"))
    members = lambda form: texts.select("text_key", "text").join(named.withColumnRenamed("form", form).join(placed.select(form).distinct(), form, "left_semi"), "text_key")
    ends = stored(members("short").select("short", "text_key", "text").mapInArrow(ending, "short bigint, text_key string, word string, blank boolean, stops boolean"))
    sites = members("long").join(placed.select("long", "at").distinct(), "long").select("long", "at", "text").mapInArrow(going_on, "long bigint, at int, word string, how string").distinct()
    offers = stored(placed.join(sites, ["long", "at"]).select("short", "back", "word", "how").distinct())
    same = ends.join(offers.select("short", "word", "how").distinct(), ["short", "word"]).select("text_key", F.expr("how = 'number' OR how = 'words' AND NOT stops").alias("cut"))
    begun = offers.where("back = 1 AND length(word) > 1").select("short", F.explode(F.expr("transform(sequence(1, length(word) - 1), n -> substring(word, 1, n))")).alias("word")).distinct()
    inside = ends.where("blank").join(begun, ["short", "word"], "left_semi").select("text_key", F.lit(True).alias("cut"))
    other = ends.join(offers.where("back = 1 OR word IS NULL").select("short").distinct(), "short", "left_semi").select("text_key", F.lit(False).alias("cut"))
    return same.unionByName(inside).unionByName(other).groupBy("text_key").agg(F.max("cut").alias("cut_inside"))


def cut_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, source, cut, reason, rate) for each document with an id and a text that isn't blank.

    reason: ``aligned``, ``broken``, ``close`` (a sentence mark after words that end no text) or ``open`` (closing
    words without a mark that end no text); null if whole. rate: the closing's. Equal texts have equal results.
    Rows without id or text, and blank ones, aren't judged; a text without any word is whole unless it is broken.
    """
    texts = usable_texts(documents)
    once = stored(different_texts(texts))
    lines = stored(marked_lines(once))
    ends = stored(closings(lines))
    rates = closing_rates(lines, ends)
    # many texts to one closing; a closing of a third of all texts is split by adaptive skew joins
    rated = ends.join(rates.drop("kind"), "closing", "left").join(aligned_cuts(once), "text_key", "left")
    reason = (
        F.when(F.col("broken"), "broken").when(F.col("cut_inside"), "aligned")
        .when((F.col("kind") == ".") & (F.col("rate") < MARKED_RATE), "close").when((F.col("kind") != ".") & (F.col("rate") < OPEN_RATE), "open")
    )
    judged = rated.select("text_key", reason.alias("reason"), "rate")
    return texts.select("doc_id", "source", "text_key").join(judged, "text_key").select("doc_id", "source", F.col("reason").isNotNull().alias("cut"), "reason", "rate")


def cut_shares(judged: DataFrame) -> DataFrame:
    """(source, documents, cut, cut_share) for each source; a null source is one of its own."""
    return judged.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count_if("cut").alias("cut")).withColumn("cut_share", F.col("cut") / F.col("documents"))
