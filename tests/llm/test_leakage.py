import random

import numpy as np
import pytest

from loomwave.llm import leakage, pages

ITEMS = [
    (1, "The curious puppeteer had hidden the rusted thermometer behind the abandoned lighthouse before the seventh winter, because nobody doubted the almanac. Question: why did the tutor wait?"),
    (2, "Every restless glassblower returned beneath the crooked aqueduct to measure the speckled hourglass twice by candlelight, yet the silent apothecary weighed it reluctantly in vinegar."),
    (3, "Every restless stonecutter returned beneath the crooked aqueduct to measure the wooden hourglass twice by candlelight, yet the learned apothecary weighed it sideways in silence."),
    (4, "too short an item"),
    (5, None),
]
WORDS = "market committee harbour report railway meeting wheat sergeant evening council petition weather vessel schoolroom members alarm applause tender slates sheep fair owing Tuesday bridge petty sessions carter named fined leaving the of and to was a in for with by on at".split()


def page(rng, lines, quote=(), at=3):
    body = [" ".join(rng.choice(WORDS) for _ in range(6)) for _ in range(lines)]
    return body[:at] + list(quote) + body[at:]


def corpus():
    rng = random.Random(4)
    w1, w2 = ITEMS[0][1].split(), ITEMS[1][1].split()
    docs = {i: page(rng, 14) for i in range(1, 41)}
    chunk = lambda w, n=5: [" ".join(w[i : i + n]) for i in range(0, len(w), n)]
    docs[101] = page(rng, 14, chunk(w1[:18]))  # plain
    docs[102] = page(rng, 14, chunk([x.upper().strip(".,") for x in w1[2:16]]))  # 14 words in capitals
    docs[103] = page(rng, 14, ["had hidden the rvsted thermo-", "meter behind tlie abandoned lighthouse", "before the seventh wlnter, because"])  # misread and broken
    docs[104] = page(rng, 14, ["had hidden the rusted thermometer", "MONEY ADVANCED upon plate,", "jewels and barley", "behind the abandoned lighthouse before", "the seventh winter, because"])  # an advert between
    docs[105] = page(rng, 14, chunk(w1[:11]))  # eleven words
    docs[106] = page(rng, 14, chunk(w1[:12]))  # twelve words
    docs[107] = page(rng, 14, chunk(w2))  # item 2, which resembles item 3
    docs[108] = page(rng, 14, ["Every patient diver returned beneath the crooked aqueduct to measure the brass globe twice by daylight"])  # resembles only
    docs[109] = docs[101]
    return docs


EXPECT = {(101, 1), (102, 1), (103, 1), (104, 1), (106, 1), (107, 2), (109, 1), (111, 1)}
SCHEMA = "doc_id long, text string, ocr_lines array<struct<line_no:int,x:int,y:int,w:int,h:int,conf:float>>, item_id string"


def boxes(lines, x=60):
    return [(i + 1, x, 100 + 25 * i, 300, 20, 0.9) for i in range(len(lines))]


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(i, "\n".join(ls), boxes(ls), "c") for i, ls in corpus().items()]
    left, right = page(random.Random(8), 9), page(random.Random(9), 6, ["had hidden the rusted thermometer", "behind the abandoned lighthouse before", "the seventh winter, because nobody"], 2)
    crossed = [(t, b) for pair in zip(zip(left, boxes(left)), zip(right, boxes(right, 420))) for t, b in pair]
    rows.append((111, "\n".join(t for t, _ in crossed), [b for _, b in crossed], "c"))
    rows += [(201, None, [], None), (202, "", [], None), (203, "  \n ", [], None), (204, "word " * 60_000, None, None), (101, rows[40][1], rows[40][2], "c")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(i, t, "cloze", 1) for i, t in ITEMS], "item_id long, text string, item_kind string, doc_id int")


def test_leaks(documents, items):
    got = {(r["doc_id"], r["item_id"]): r["n_words"] for r in leakage.find_leaks(documents, items).where("quoted").collect()}
    assert set(got) == EXPECT
    assert got[106, 1] == 12 and got[101, 1] == 18


def test_blocks_of_items_give_the_same(documents, items):
    whole, blocks = (sorted(leakage.find_leaks(documents, items, leakage.Settings(block_chars=n)).collect()) for n in (10, 10**6))
    assert whole == blocks and {(r["doc_id"], r["item_id"]) for r in whole if r["quoted"]} == EXPECT


def test_report_and_empty_tables(documents, items):
    leaks = leakage.find_leaks(documents, items)
    report = {r["item_id"]: (r["n_pages"], r["longest"]) for r in leakage.item_report(leaks, items).collect()}
    assert report[2] == (1, 25) and report[4] == (0, 0)
    assert leakage.find_leaks(documents.where("false"), items).count() == 0
    assert leakage.find_leaks(documents, items.where("false")).count() == 0


def test_words_and_order():
    assert pages.page_words("Fam-\niliar ſeven£ 5ea, 'tis\r\nbro¬\nken") == pages.page_words("familiar seven sea tis broken")
    assert pages.tolerance(b"a") == 0 and b"ac" in pages.deletions(b"abc", 1)


def found(spark, docs, items, **settings):
    rows = [(i, t, None, None) for i, t in docs]
    df = spark.createDataFrame(rows, SCHEMA.replace("item_id string", "word string"))
    return {(r["doc_id"], r["item_id"]): r for r in leakage.find_leaks(df, spark.createDataFrame(items, "item_id long, text string"), leakage.Settings(**settings)).collect()}


def test_items_on_most_pages_are_found(spark):
    item = ITEMS[0][1]
    rng = random.Random(3)
    assert set(found(spark, [(1, item)], [(1, item)])) == {(1, 1)}
    docs = [(i, item) for i in range(3)] + [(9, "\n".join(page(rng, 8)))]
    assert {k for k, r in found(spark, docs, [(1, item)]).items() if r["quoted"]} == {(0, 1), (1, 1), (2, 1)}
    assert {k for k, r in found(spark, [(i, item) for i in range(4)], [(1, item), (2, ITEMS[1][1])]).items() if r["quoted"]} == {(i, 1) for i in range(4)}


def test_item_passages_beyond_the_latent_space(spark):
    docs = [(i, "\n".join(ls)) for i, ls in corpus().items() if i < 108]
    got = found(spark, docs, [i for i in ITEMS if i[1]], rank=2, oversample=2)
    assert {k for k, r in got.items() if r["quoted"]} >= {(101, 1), (102, 1), (104, 1), (106, 1), (107, 2)}


def test_long_words_and_long_runs(spark):
    rng = random.Random(6)
    long = ["".join(rng.choice("abdefghkmnopqrstuvwxyz") for _ in range(n)) for n in (24, 25, 26, 40, 45, 60)]
    plain = ITEMS[1][1].split()
    text = " ".join(f"{x} {plain[2 * i]} {plain[2 * i + 1]}" for i, x in enumerate(long))
    misread = " ".join(f"{x[:9]}x{x[10:20]}{x[21:]} {plain[2 * i]} {plain[2 * i + 1]}" for i, x in enumerate(long))
    others = [(10 + i, "\n".join(page(rng, 9))) for i in range(9)]
    assert found(spark, [(1, misread), *others], [(1, text)])[1, 1]["n_words"] == 18
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}k{chr(97 + i // 676 % 26)}" for i in rng.sample(range(17576), 2000)]
    run = " ".join(words[rng.randrange(2000)] for _ in range(32780))
    assert found(spark, [(1, run)], [(1, run)])[1, 1]["n_words"] == 32780


def test_paraphrases_carry_the_answer(spark):
    item = "The curious puppeteer had hidden the rusted thermometer behind the abandoned lighthouse before the seventh winter. Question: where was the thermometer hidden by the puppeteer?"
    told = "The curious old puppeteer had then hidden away the rusted brass thermometer just behind the very abandoned lighthouse before seventh winter came"
    near = "The patient diver had then hidden away the wooden brass globe just behind the very crooked aqueduct before seventh winter came"
    rng = random.Random(1)
    docs = [(1, told), (2, near)] + [(10 + i, "\n".join(page(rng, 9))) for i in range(20)]
    got = found(spark, docs, [(7, item)])
    assert set(got) == {(1, 7)} and got[1, 7]["answered"] and not got[1, 7]["quoted"]
    assert leakage.split_question("A b. C d?") == ("A b.", " C d?")
    assert leakage.split_question("A b. C d.") == ("A b. C d.", "")


def test_common_subsequences():
    rng = random.Random(8)
    words = leakage.Words(["a b c d e f g h"])
    for _ in range(200):
        items = [leakage.Item(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 20))), words, np.ones(8)) for i in range(4)]
        row = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 30))]
        laid = leakage.Laid(items)
        got = laid.common([laid.mask(np.array([words.number[w.encode()]])) for w in row])
        for item, n in zip(items, got):
            table = [0] * (len(item.words) + 1)
            for w in row:
                left = 0
                for j, x in enumerate(item.words.tolist()):
                    old = table[j + 1]
                    table[j + 1] = left + 1 if x == words.number[w.encode()] else max(table[j], table[j + 1])
                    left = old
            assert n == table[-1]


def test_recall_with_many_words(spark):
    """Runs of twelve words, some misread, of items with a large vocabulary: the search finds what an alignment with every item finds."""
    rng = random.Random(12)
    syllables = [a + b for a in "bdfgkmprstvz" for b in "aeiou"]
    vocabulary = ["".join(rng.choice(syllables) for _ in range(rng.randint(2, 5))) for _ in range(6000)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(60))) for i in range(150)]
    docs, planted = [], set()
    for d in range(300):
        words = [rng.choice(vocabulary if rng.random() < 0.2 else WORDS) for _ in range(150)]
        if d % 3 == 0:
            i = rng.randrange(150)
            at = rng.randrange(48)
            run = items[i][1].split()[at : at + 12]
            for k in rng.sample(range(12), d % 4):
                run[k] = run[k][:1] + "x" + run[k][2:]
            words[70:70] = run
            planted.add((d, i))
        docs.append((d, "\n".join(" ".join(words[k : k + 6]) for k in range(0, len(words), 6))))
    got = {k for k, r in found(spark, docs, items).items() if r["quoted"]}
    assert got <= planted and len(got) >= 0.98 * len(planted)


def test_letters_in_common():
    assert pages.common_letters(b"puppeteer", b"pupeter") == 7
    assert pages.shares_letters(b"a" * 30 + b"xyz", b"a" * 30 + b"xz", 2)
    assert not pages.shares_letters(b"a" * 30 + b"uvw", b"a" * 30 + b"xyz", 2)
