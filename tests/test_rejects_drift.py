import json

import pytest

from loomwave.operators import drift, rejects

BASE = {"onset": "number", "duration": "number", "trial_type": "string", "response_time": "number", "stim_file": "string"}
HEAD = "onset\tduration\ttrial_type\tresponse_time\tstim_file"
CASES = [
    ("1.5\t0.6\tgo\t0.2\ta.png", None), ("1.5\t0.6\tgo\tn/a\ta.png\r", None), (" +1. \t\tgo\t\t", None), (".5e-3\t1\tgo\t1\tx", None), ('"1.5"\t1\t"a\tb"\t"n/a"\t"x ""y"" z"', None),
    ('1\t1\t"two\nlines"\t1\t"c\rd"', None), ("1\t1\tgo\t1", "wrong_field_count"), ("1\t1\tgo\t1\tx\t", "wrong_field_count"), ("", "wrong_field_count"), ("   ", "wrong_field_count"), (None, "wrong_field_count"),
    ('1\t1\tg"o\t1\tx', "broken_quoting"), ('1\t1\t"go\t1\tx', "broken_quoting"), ('1\t1\t"go"x\t1\tx', "broken_quoting"), ('1\t1\t"g"o"\t1\tx', "broken_quoting"), ('1\t1\tgo\t1\tx"', "broken_quoting"),
    ("NaN\t1\tgo\t1\tx", "bad_onset"), ("\t1\tgo\t1\tx", "bad_onset"), ("n/a\t1\tgo\t1\tx", "bad_onset"), ("1,5\t1\tgo\t1\tx", "bad_onset"), ("١\t1\tgo\t1\tx", "bad_onset"), (".\t1\tgo\t1\tx", "bad_onset"), ("0x1F\t1\tgo\t1\tx", "bad_onset"), ("1_0\t1\tgo\t1\tx", "bad_onset"),
    ("1\t1\tgo\tnull\tx", "bad_response_time"), ("1\t1\tgo\t-inf\tx", "bad_response_time"), ("1\t1\tgo\t1 2\tx", "bad_response_time"), ("1\tabc\tgo\t1E3\tx", None), ("1\t1\ta\rb\t1\tmid\r\r", None), ("1\t1\t\t1\t1", None),
]


def lines(spark, rows):
    return spark.createDataFrame([(*r, "extra") for r in rows], "line_id long, file_id long, line_no int, raw_line string, columns string")


def test_reasons(spark):
    rows = [(0, 1, 1, HEAD)] + [(i + 1, 1, i + 2, t) for i, (t, _) in enumerate(CASES)]
    got = {r["line_id"]: r for r in rejects.parse_lines(lines(spark, rows + rows[3:5]), list(BASE)).collect()}
    assert len(got) == len(CASES)
    for i, (text, reason) in enumerate(CASES):
        assert got[i + 1]["reason"] == reason, repr(text)
    assert got[5]["fields"] == ["1.5", "1", "a\tb", "n/a", 'x "y" z'] and got[5]["onset"] == 1.5 and got[5]["response_time"] is None
    assert got[6]["fields"][2] == "two\nlines" and got[6]["fields"][4] == "c\rd"
    assert got[29]["fields"][2] == "a\rb" and got[29]["fields"][4] == "mid\r"
    assert got[30]["fields"][2] == "" and got[30]["fields"][4] == "1"


def test_headers_that_differ_and_none(spark):
    rows = [(1, 1, 1, "onset\tRT\r"), (2, 1, 2, "1\tx"), (3, 1, 3, "1\tn/a"), (4, 2, 1, "stim_file\tonset"), (5, 2, 2, "7\t2"), (6, 2, 3, "x\ty"), (7, 3, 2, "1\t2")]
    got = {r["line_id"]: r["reason"] for r in rejects.parse_lines(lines(spark, rows), list(BASE)).collect()}
    assert got == {2: "bad_response_time", 3: None, 5: None, 6: "bad_onset", 7: "no_header"}


def test_empty_and_very_long(spark):
    assert rejects.parse_lines(lines(spark, []), list(BASE)).count() == 0
    long = "x" * 3_000_000
    got = rejects.parse_lines(lines(spark, [(1, 1, 1, HEAD), (2, 1, 2, f"1\t1\t{long}\t1\tx")]), list(BASE)).collect()
    assert got[0]["reason"] is None and len(got[0]["fields"][2]) == len(long)


def test_renames_pair_by_name():
    assert rejects.pair_renamed(["response_time", "stim_file"], ["stimulus", "RT", "hed"]) == {"response_time": "RT", "stim_file": "stimulus"}
    assert rejects.pair_renamed(["response_time"], ["hed", "resp_time"]) == {"response_time": "resp_time"}
    assert rejects.pair_renamed([], ["a"]) == {} and rejects.pair_renamed(["a"], []) == {}


SIDE = {"A": "string", "N": "number", "H": "object", "H.F": "object", "H.F.R": "string", "H.F.C": "number", "B": "boolean"}
FULL = {"A": "x", "N": 1, "H": {"F": {"R": "r", "C": 2.5}}, "B": True}


@pytest.mark.parametrize(
    ("record", "expect"),
    [
        (FULL, set()),
        ({**FULL, "A": None, "N": 1.5}, set()),
        ({k: v for k, v in FULL.items() if k != "A"}, {("A", "removed")}),
        ({**{k: v for k, v in FULL.items() if k != "A"}, "AA": "y", "Z": "q"}, {("A", "renamed"), ("Z", "added")}),
        ({**{k: v for k, v in FULL.items() if k != "A"}, "Z": 5}, {("A", "removed"), ("Z", "added")}),
        ({**FULL, "H": "flat"}, {("H", "retyped")}),
        ({k: v for k, v in FULL.items() if k != "H"}, {("H", "removed")}),
        ({**FULL, "H": {"G": {"X": 1}}}, {("H.F", "renamed")}),
        ({**FULL, "H": {"F": {"R": 18, "C": "2", "O": 1}}}, {("H.F.R", "retyped"), ("H.F.C", "retyped"), ("H.F.O", "added")}),
        ({**FULL, "Q": {"deep": {"x": 1}}, "E": None}, {("Q", "added")}),
        ({**FULL, "B": 0, "A": ["l"]}, {("B", "retyped"), ("A", "retyped")}),
    ],
)
def test_levels(record, expect):
    assert set(drift.compare_levels(record, SIDE)[0]) == expect


def test_rescue_and_replay(spark):
    rows = [(1, json.dumps(FULL)), (1, json.dumps(FULL)), (2, json.dumps({**FULL, "N": "7", "Z": 3, "W": "w"})), (3, None), (4, "{broken"), (5, "[1]")]
    got = drift.ingest_json(spark.createDataFrame(rows, "file_id long, body string"), SIDE)
    by = {r["file_id"]: r for r in got.collect()}
    assert len(by) == 5 and by[1]["_rescued"] is None and by[1]["H__F__C"] == 2.5 and by[1]["B"] is True
    assert json.loads(by[2]["_rescued"]) == {"N": "7", "Z": 3, "W": "w"} and by[2]["N"] is None
    assert by[3]["A"] is None and by[3]["_rescued"] is None and "_corrupt" in by[4]["_rescued"] and "_corrupt" in by[5]["_rescued"]
    again = {r["file_id"]: r for r in drift.replay_rescued(got, {"N": ("N", "number"), "Z": ("z_new", "number")}).collect()}
    assert again[2]["N"] == 7.0 and again[2]["z_new"] == 3.0 and json.loads(again[2]["_rescued"]) == {"W": "w"} and again[1]["N"] == 1.0
    promoted = {r["file_id"]: r for r in drift.ingest_json(spark.createDataFrame(rows, "file_id long, body string"), SIDE, {"Z": ("z", "number")}).collect()}
    assert promoted[2]["z"] == 3.0 and json.loads(promoted[2]["_rescued"]) == {"N": "7", "W": "w"}


def test_header_changes_and_table(spark):
    rows = [(1, 1, 1, "onset\tduration\ttrial_type\tRT\tstim_file\thed"), (2, 1, 2, "1\t1\tgo\t1\t505\tL"), (3, 1, 3, "1\tn/a\t5\tn/a\tn/a\t"), (4, 1, 4, "bad\t1\tgo\t1\tx.png\tL"), (5, 2, 1, "onset\tduration\ttrial_type\tresponse_time"), (6, 3, 1, "onset\tduration\ttrial_type\tresponse_time\tstim_file"), (7, 3, 2, "1\tlong\tgo\t1\tx")]
    got = {tuple(r) for r in drift.header_changes(lines(spark, rows), BASE).collect()}
    assert got == {(1, "response_time", "renamed"), (1, "hed", "added"), (1, "stim_file", "retyped"), (2, "stim_file", "removed"), (3, "duration", "retyped")}
    table = {r["line_id"]: r for r in drift.events_table(lines(spark, rows), BASE).collect()}
    assert set(table) == {2, 3, 7} and table[2]["response_time"] == 1.0 and json.loads(table[2]["_rescued"]) == {"hed": "L"}
    assert table[7]["duration"] is None and json.loads(table[7]["_rescued"]) == {"duration": "long"}
