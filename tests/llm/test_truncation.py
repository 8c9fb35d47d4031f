"""Cut texts: held-out cuts of whole texts are found, closes that texts use are not flagged."""

import random

from siderite.llm import truncation

SCHEMA = "doc_id bigint, source string, text string, cut string"
SENTENCES = [
    "The crust is thin and dark, with flow lines near the rim.", "Our scale was checked in May, so the mass is good to approx. 0.02 g.", "We measured it at 21 mm along the longest side.",
    "Did anyone keep the field book of 1931?", "A lab slice was kept for study; the rest went to a school.", "Please ask for more photographs before you order.", "It was found by two herders near a dry lake.",
]
CLOSES = ["", "\nKind regards\nThe Cabinet", "\nPrice: 30 USD", "\n(photographs by the seller)", "\nMore photographs soon..."]


def corpus(n=600):
    rng = random.Random(9)
    return [" ".join(rng.choice(SENTENCES) for _ in range(rng.randint(2, 9))) + rng.choice(CLOSES) for _ in range(n)]


def judge(spark, rows):
    return {r["doc_id"]: r for r in truncation.cut_documents(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_cuts_are_found_and_whole_texts_kept(spark):
    rng = random.Random(10)
    texts = corpus()
    cut = {}
    for i in range(0, 600, 15):
        while True:
            at = rng.randint(20, len(texts[i].split("\n")[0]) - 4)
            if texts[i][at - 1] not in " .?;," and texts[i][at] not in ".?;,":
                break
        cut[i] = texts[i][:at]
    rows = [(i, f"s{i % 3}", cut.get(i, t), "x") for i, t in enumerate(texts)]
    found = judge(spark, rows)
    flagged = {i for i, r in found.items() if r["cut"]}
    assert len(flagged & set(cut)) >= 0.95 * len(cut) and len(flagged - set(cut)) <= 3


def test_abbreviation_open_tag_and_broken_character(spark):
    rows = [(i, "s", t, None) for i, t in enumerate(corpus(2500))]
    rows += [(9001, "s", "It was found by two herders near a dry lake. So the mass is good to approx.", None), (9002, "s", "We measured it at 21 mm <a href=", None), (9003, "s", "We measured it at 21 mm al�", None)]
    found = judge(spark, rows)
    assert found[9001]["reason"] == "close" and found[9002]["reason"] == "broken" and found[9003]["reason"] == "broken"


def test_aligned_copy_is_found(spark):
    rng = random.Random(11)
    long = " ".join(rng.choice(SENTENCES) for _ in range(40))
    texts = spark.createDataFrame([("a", long), ("b", long[: int(len(long) * 0.93)] + ""), ("c", " ".join(reversed(long.split()))), ("d", "short")], "text_key string, text string")
    got = {r["text_key"] for r in truncation.aligned_cuts(texts).collect()}
    assert got <= {"b"} and (got == {"b"})


def test_alignment_tells_ends_from_cuts(spark):
    rng = random.Random(12)
    head = " ".join(rng.choice(SENTENCES) for _ in range(30))
    pairs = {"number": ("\nLot: 58", "09 and more"), "word": (" It was fou", "nd by two herders."), "sentence": (" It was found.", " And sold again."), "line": ("\nPrice: 30 USD", "\nLot: 5"), "decimal": (" It is good to 0.", "02 g.")}
    rows = [(f"{k}-{side}", f"Copy {k}. {head}{a}{b if side == 'long' else ''}") for k, (a, b) in pairs.items() for side in ("short", "long")]
    got = {r["text_key"]: r["cut_inside"] for r in truncation.aligned_cuts(spark.createDataFrame(rows, "text_key string, text string")).collect()}
    assert got == {"number-short": True, "word-short": True, "sentence-short": False, "line-short": False, "decimal-short": True}


def test_nulls_blanks_repeats_and_empty(spark):
    rows = [(1, None, "Whole text ends here.", None), (1, "s", "Whole text ends here.", None), (2, "s", None, None), (3, "s", "", None), (4, "s", "  \n ", None), (None, "s", "abc", None), (5, "s", "§§§", None), (6, "s", "word " * 30_000, None)]
    found = truncation.cut_documents(spark.createDataFrame(rows, SCHEMA))
    assert sorted(r["doc_id"] for r in found.collect()) == [1, 1, 5, 6]
    assert truncation.cut_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    assert truncation.cut_shares(found).where("source IS NULL").first()["documents"] == 1


def test_edited_near_copies_are_aligned(spark):
    """Longer texts with cut copies that differ earlier in words, numbers, case and blanks: the cut ones are flagged, whole ones aren't."""
    rng = random.Random(13)
    rows, cut = [], set()
    for i in range(60):
        long = f"Copy {i} of the field book. " + " ".join(f"{rng.choice(SENTENCES)[:-1]} in lot {rng.randint(1, 9999)}." for _ in range(30))
        rows.append((f"{i}-long", long))
        at = int(len(long) * rng.uniform(0.87, 0.95))
        while long[at - 1] in " .?;," or long[at] in ".?;,":
            at += 1
        short = long[:at]
        if i % 3 == 1:  # an end with the sentence is no cut
            short = short[: short.rindex(". ") + 1]
        edited = short.replace("dark", "black", 1).replace("May", "MAY", 1).replace(" the ", "  the ", 2).replace("Copy", "copy", 1)
        rows.append((f"{i}-short", edited))
        if i % 3 != 1:
            cut.add(f"{i}-short")
    got = {r["text_key"]: r["cut_inside"] for r in truncation.aligned_cuts(spark.createDataFrame(rows, "text_key string, text string")).collect()}
    found = {k for k, inside in got.items() if inside}
    assert len(found & cut) >= 0.9 * len(cut) and found <= cut


def test_aligned_end_of_one_pair():
    head = " ".join(SENTENCES * 4)
    cases = {
        ("It was fou", "It was found here."): True, ("It was", "It was found here."): True, ("It was found.", "It was found. Later it was sold."): False, ("It was found...", "It was found later here."): True,
        ("It was found\n", "It was found\nLater it was sold."): False, ("good to 0.", "good to 0.02 g today."): True, ("It was found", "It was found"): False, ("It was sold", "It was found here."): False,
    }
    for (short, long), want in cases.items():
        assert truncation.aligned_end(f"{head} {short}", f"{head} {long}")[1] == want, (short, long)
    assert truncation.aligned_end("a b c d e f", "u v w x y z") == (0.0, None) and truncation.aligned_end("", "a b")[1] is None
    assert truncation.aligned_end(head.upper() + " IT WAS", head + " it was found here.")[1] is True


def test_every_near_copy_is_met(spark):
    """Families of near-copies, most alike to another member and not to the longest: as aligned_end over all pairs tells."""
    rng = random.Random(14)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    texts = {}
    for family in range(12):
        base = [rng.choice(words) if rng.random() > 0.15 else str(rng.randint(1, 99)) for _ in range(60)]
        for member in range(12):
            own = list(base)
            for _ in range(rng.randint(0, 2)):  # edits that part a member from many others
                own[rng.randrange(45)] = rng.choice(words)
            if member == 4:
                own = own[20:] + own[:20]
            if member == 5:  # as long again, the same shingles
                own = own + own
            text = " ".join(own + [rng.choice(words) for _ in range(rng.randint(0, 4))][: 12 - member]) + rng.choice(["", ".", "...", "\n"])
            cut = rng.choice([0, 0, 3, 9, 15])
            texts[f"{family}-{member}"] = text[: len(text) - cut]
    texts |= {f"lot-{i}": " ".join(words[:40]) + f" lot {i}" + (f" and {i * 7} more" if i % 2 else "") for i in range(20)}
    want = {}
    for x, a in texts.items():
        for y, b in texts.items():
            if len(a.replace(".", " ").split()) < len(b.replace(".", " ").split()) and (judged := truncation.aligned_end(a, b))[0] >= truncation.SIMILARITY and judged[1] is not None:
                want[x] = want.get(x, False) or judged[1]
    rows = spark.createDataFrame(list(texts.items()), "text_key string, text string")
    assert {r["text_key"]: r["cut_inside"] for r in truncation.aligned_cuts(rows).collect()} == want
    assert sum(want.values()) > 20 and len(want) > sum(want.values()) + 10


def test_a_copy_like_a_shorter_member_only_is_met(spark):
    """Thirty longer texts resemble the middle one, none of them the short one, whose cut the middle one alone shows."""
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    edited = lambda own, at, word: [*own[:at], word, *own[at + 1 :]]
    middle = words[:100]
    rows = [("short", " ".join(edited(middle[:97], 10, "edited"))), ("middle", " ".join(middle) + ".")]
    rows += [(f"longer-{i}", " ".join([*edited(middle, 20 + 2 * i, words[100 + i]), *words[200 + 3 * i : 203 + 3 * i], "end"]) + ".") for i in range(30)]
    similar = [k for k, t in rows[1:] if truncation.aligned_end(rows[0][1], t)[0] >= truncation.SIMILARITY]
    assert similar == ["middle"]
    got = {r["text_key"]: r["cut_inside"] for r in truncation.aligned_cuts(spark.createDataFrame(rows, "text_key string, text string")).collect()}
    assert got["short"] is True
