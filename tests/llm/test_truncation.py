import random

import numpy as np
import pytest

from loomwave.llm import truncation

SUBJECTS = "alderman sergeant doctor captain baker farrier printer draper miller weaver".split()
VERBS = "observed deposed stated resolved repaired inspected described carried".split()
THINGS = "footbridge chimney lantern sluice barometer engine clock plough tollhouse slates".split()
PLACES = "harbour guildhall market railway schoolroom hospital assembly institute".split()


def sentence(rng):
    return f"The {rng.choice(SUBJECTS)} {rng.choice(VERBS)} the {rng.choice(THINGS)} at the {rng.choice(PLACES)} {rng.randint(2, 99)} times before the {rng.choice(THINGS)} was {rng.choice(VERBS)}."


def article(rng, n=12):
    return " ".join(sentence(rng) for _ in range(n))


def lines(text, width=40):
    out, now = [], ""
    for w in text.split():
        if len(now) + len(w) + 1 > width:
            out.append(now)
            now = w
        else:
            now = f"{now} {w}".strip()
    return [*out, now]


def row(i, text, source="s", crossed=None):
    ls = text.split("\n")
    boxes = crossed or [(k + 1, 60, 100 + 25 * k, 8 * max(len(x), 1), 20, 0.9) for k, x in enumerate(ls)]
    return (i, text, source, boxes, "w")


@pytest.fixture(scope="module")
def documents(spark):
    rng = random.Random(11)
    rows, cut = [], set()
    for i in range(120):
        text = "\n".join(lines(article(rng)))
        ending = i % 4
        if ending == 1:
            text += "\nPrinted for the Proprietors by\n" + rng.choice(["Aldwick", "Selby", "Holm"]) + " & Co., " + rng.choice(["Millford", "Oldbury", "Redport"])
        elif ending == 2 and i % 8 == 2:
            text = text[: rng.randint(300, 600)].rstrip(".\n ")
            cut.add(i)
        rows.append(row(i, text))
    whole = "\n".join(lines(article(rng, 20)))
    rows.append(row(500, whole))
    rows.append(row(501, whole[: int(len(whole) * 0.85)].rstrip(". \n")))
    rows.append(row(502, whole[: int(len(whole) * 0.85)].rstrip(". \n")))
    cut |= {501, 502}
    rows.append(row(503, "\n".join(lines(article(rng) + " Then came Mr."))))
    rows.append(row(504, "\n".join(lines(article(rng) + ' "It was so," said he, "since the hall was founded."'))))
    rows.append(row(505, "\n".join(lines(article(rng) + " The price was 15s."))))
    rows.append(row(506, "\n".join(lines(article(rng) + " Away went 15s.."))))
    cut |= {503, 505}
    left, right = lines(article(rng, 6)), lines(article(rng, 6))
    n = min(len(left), len(right))
    right = [*right[: n - 1], "and so it ended."]
    pairs = [(t, (0, x, 100 + 25 * k, 8 * len(t), 20, 0.9)) for k in range(n) for t, x in ((left[k], 60), (right[k], 480))]
    rows.append(row(510, "\n".join(t for t, _ in pairs), crossed=[b for _, b in pairs]))
    short = [*pairs[:-1], (pairs[-1][0][:5], pairs[-1][1])]
    rows.append(row(511, "\n".join(t for t, _ in short), crossed=[b for _, b in short]))
    cut.add(511)
    rows += [(601, None, "s", [], None), (602, "", "s", [], None), (603, " \n ", "s", None, None), (604, "word " * 50_000 + "end.", None, None, None), rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, ocr_lines array<struct<line_no:int,x:int,y:int,w:int,h:int,conf:float>>, word string")
    return df, cut


def test_found(documents):
    df, cut = documents
    got = truncation.find_truncated(df).collect()
    assert len({r["doc_id"] for r in got}) == len(got)
    assert {r["doc_id"] for r in got} == cut
    assert {r["doc_id"]: r["reason"] for r in got}[501] == "near_copy_goes_on"


SCHEMA = "doc_id long, text string, source string, ocr_lines array<struct<line_no:int,x:int,y:int,w:int,h:int,conf:float>>, word string"


def test_copies_cut_alike_show_no_closing(spark):
    rng = random.Random(21)
    rows = [row(i, "\n".join(lines(article(rng)))) for i in range(60)]
    body, end = article(rng, 10), " Lastly Zebulon Quennerstedt brought hither seventeen uncommonly gnarled"
    cut = set()
    for i in range(12):
        words = body.split()
        words[7 * i] += "q"
        rows.append(row(100 + i, "\n".join(lines(" ".join(words) + end))))
        cut.add(100 + i)
    assert {r["doc_id"] for r in truncation.find_truncated(spark.createDataFrame(rows, SCHEMA)).collect()} == cut


def test_exact_copies_count_once(spark):
    rng = random.Random(23)
    imprint = "Printed for the Proprietors by Selby & Co., Oldbury"
    rows = []
    for i in range(60):
        words = article(rng).split()
        for k, w in enumerate(["printed", "for", "proprietors", "by", "selby", "co", "oldbury"] * 2):
            if i % 3 == 0:
                words.insert(9 * k + 3, w)
        rows.append(row(i, "\n".join(lines(" ".join(words))) + ("\n" + imprint if i % 3 == 1 else "")))
    hot = "Notice is hereby given that the harbour committee will"
    rows += [row(1000 + i, hot) for i in range(900)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r["doc_id"] for r in truncation.find_truncated(df).collect()} == {*range(1000, 1900)}
    _, words = truncation.page_features(df, truncation.Settings())
    _, once = truncation.page_features(df.where("doc_id <= 1000"), truncation.Settings())
    table = lambda w: {r["word"]: (r["n"], r["n_dotted"]) for r in w.collect()}
    assert table(words) == table(once)


def test_a_closing_at_the_limit_is_cut(spark):
    rng = random.Random(22)
    imprint = "\nPrinted for the Proprietors by Selby & Co., Oldbury"
    rows = [row(i, "\n".join(lines(article(rng))) + (imprint if i % 2 else "")) for i in range(60)]
    for i in range(6):
        text = "\n".join(lines(article(rng, 20)))
        rows.append(row(100 + i, text[:400].rstrip(".\n ").ljust(400, "e"), "limited"))
    text = "\n".join(lines(article(rng, 20)))
    rows.append(row(110, text[: 400 - len(imprint)] + imprint, "limited"))
    rows.append(row(111, text[: 380 - len(imprint)] + imprint, "limited"))
    assert {r["doc_id"] for r in truncation.find_truncated(spark.createDataFrame(rows, SCHEMA)).collect()} == {*range(100, 106), 110}


def test_near_classes(spark):
    pages = spark.createDataFrame([(i, i % 20) for i in range(40)], "doc_id long, copy_key long")
    chain = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(11, 12)], "a long, b long")
    groups = {}
    for r in truncation.near_classes(pages, chain).collect():
        groups.setdefault(r["class"], set()).add(r["copy_key"])
    assert sorted(map(len, groups.values())) == [2, 10]


def test_report(documents):
    df, cut = documents
    report = {r["source"]: r for r in truncation.truncation_report(df, truncation.find_truncated(df)).collect()}
    assert (report["s"]["n_cut"], report["s"]["n_pages"]) == (len(cut), 129)
    assert (report[None]["n_cut"], report[None]["share"]) == (0, 0.0)


def test_empty(documents):
    df, _ = documents
    assert truncation.find_truncated(df.where("false")).count() == 0
    assert truncation.find_truncated(df.where("text is null")).count() == 0


def test_alignment():
    s = truncation.Settings()
    whole = article(random.Random(1), 8)
    compare = lambda a, b: truncation.compare_ends(a, b, s)
    assert compare(whole[: len(whole) * 9 // 10], whole) in ("early", "inside")
    assert compare(whole, whole) == "same"
    assert compare(whole + " More text follows here and goes on for quite a while now indeed.", whole) == "late"
    assert compare(article(random.Random(2), 8), whole) is None
    assert compare("", whole) is None and compare(whole, "") is None
    assert compare("one two", "one two three four five six seven") == "inside"


def test_alignment_of_repeated_phrases():
    s = truncation.Settings()
    imprint = "Printed for the Proprietors by Selby & Co. at their office in Oldbury"
    whole = f"{imprint} {article(random.Random(3), 10)} {imprint}"
    assert truncation.compare_ends(whole, whole, s) == "same"
    for share in (0.95, 0.9, 0.85):
        cut = whole[: int(len(whole) * share)]
        assert truncation.compare_ends(cut, whole, s) in ("early", "inside")
        assert truncation.compare_ends(whole, cut, s) == "late"
    assert truncation.compare_ends("word " * 3000, "word " * 4000, s) in ("early", "inside")


def test_alignment_of_misread_ends():
    s = truncation.Settings()
    words = article(random.Random(5), 12).split()
    misread = [*words[:-2], words[-2].replace("a", "x"), words[-1]]
    assert truncation.compare_ends(" ".join(misread), " ".join(words), s) == "same"
    words = words[:-2]
    assert truncation.compare_ends(" ".join([*words[:-1], words[-1][:3]]), " ".join(words), s) in ("early", "inside")
    assert truncation.compare_ends("He came with Mr.", "He came with Mr. smith to town and went home", s) == "early"
    assert truncation.compare_ends("He came with the. ", "He came with the whole town and went home", s) == "inside"


def noisy(rng, text, share):
    return " ".join(w[: len(w) // 2] + "x" + w[len(w) // 2 + 1 :] if len(w) > 3 and rng.random() < share else w for w in text.split())


def test_planted_near_copies_are_found(spark):
    """By the near-copy step alone: every page ends with a sentence mark removed, so no closing tells it apart."""
    rng = random.Random(31)
    rows, cut, i = [], set(), 0
    for _ in range(40):
        whole = article(rng, 20)
        rows.append((i, noisy(rng, whole, 0.01)))
        part = whole[: int(len(whole) * rng.uniform(0.6, 0.97))]
        rows.append((i + 1, noisy(rng, part, 0.01)))
        cut.add(i + 1)
        i += 2
    df = spark.createDataFrame([row(k, "\n".join(lines(t))) for k, t in rows], SCHEMA)
    s = truncation.Settings()
    pages, _ = truncation.page_features(df, s)
    early = truncation.early_texts(pages, truncation.near_links(df, pages, s)[1])
    got = {r["doc_id"] for r in early.join(pages, "copy_key").collect()}
    assert got <= cut and len(got) >= 0.9 * len(cut)


@pytest.mark.parametrize("part", [10_000, 2])
def test_a_poor_longest_copy_hides_nothing(spark, part):
    """The longest of a group is so misread that cut copies fail beside it; a cleaner whole one further down decides."""
    rng = random.Random(32)
    whole = article(rng, 25)
    texts = {1: noisy(rng, whole, 0.09) + " Added at the end of it all.", 2: whole}
    for i in range(6):
        texts[10 + i] = " ".join(noisy(rng, whole, 0.025).split()[: -6 - i])
    df = spark.createDataFrame([row(k, "\n".join(lines(t))) for k, t in texts.items()], SCHEMA)
    s = truncation.Settings(part=part)
    assert any(truncation.compare_ends(texts[10 + i], texts[1], s) is None for i in range(6))
    pages, _ = truncation.page_features(df, s)
    early = truncation.early_texts(pages, truncation.near_links(df, pages, s)[1])
    assert {r["doc_id"] for r in early.join(pages, "copy_key").collect()} >= {10 + i for i in range(6)}


def test_signatures_estimate_likeness():
    rng = random.Random(3)
    words = [f"w{rng.randint(0, 10**6)}".encode() for _ in range(3000)]
    for share in (0.9, 0.6, 0.3):
        a, b = truncation.shingle_hashes(words, 1), truncation.shingle_hashes(words[: int(3000 * share)], 1)
        x, y = truncation.signature(a, 960), truncation.signature(b, 960)
        assert abs((x == y).mean() - share) < 0.07
    assert (truncation.signature(np.zeros(0, np.uint64), 8) == 2**32 - 1).all()


def test_sentence_marks():
    assert truncation.sentence_final('He said so."') == (True, "so")
    assert truncation.sentence_final("for £3 4s.") == (True, "d")
    assert truncation.sentence_final("for £3 4s..") == (True, None)
    assert truncation.sentence_final("to the rail-\nway.") == (True, "railway")
    assert truncation.sentence_final("and so,")[0] is False


def test_evidence_grows_with_the_count(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(0, 1.0), (3, 3.0), (6, 0.2), (12, 0.4)], "seen long, chance double")
    got = [r[0] for r in df.select(truncation.evidence(F.col("seen"), F.col("chance"))).collect()]
    assert got[0] == pytest.approx(1.0) and got[1] == pytest.approx(0.0) and got[3] == pytest.approx(2 * got[2])
    bound = [r[0] for r in spark.createDataFrame([(6, 6), (12, 14), (5, 5)], "c long, n long").select(truncation.lower_bound(F.col("c"), F.col("n"))).collect()]
    assert bound == pytest.approx([0.6097, 0.6006, 0.5655], abs=1e-3)
