"""Files as they are found in practice."""

import pytest
from pyspark.sql import functions as F

from answerflow.sources.runlogs import parse_run_summaries, read_run_logs, repair_wrapped_records
from answerflow.session import scratch_path, shared_dir

WRAPPED = (
    "QID,model_answer,question,correct_answer,time,category\n"
    "1,A,What is one?,A,1.5,math\n"
    '2,b,A question, with commas\n   over three  \n\nlines,B,0.25,law and order\n'
    '3,C,"She said ""no"", twice",C,slow,other\r\n'
    "4, D ,last, D ,2, x \n"
)


def test_wrapped_records(spark, tmp_path):
    (tmp_path / "one.csv").write_bytes(WRAPPED.encode())
    rows = {r.QID: r for r in repair_wrapped_records(spark, str(tmp_path)).collect()}
    assert set(rows) == {1, 2, 3, 4}
    assert rows[1][1:] == (1, "A", "What is one?", "A", 1.5, "math")
    assert rows[2].question == "A question, with commas over three  lines"
    assert (rows[2].correct_answer, rows[2].time, rows[2].category) == ("B", 0.25, "law and order")
    assert (rows[3].question, rows[3].time) == ('She said "no", twice', None)
    assert rows[4][1:] == (4, "D", "last", "D", 2.0, "x")


def test_wrapped_records_across_file_blocks(spark, tmp_path):
    lines = ["QID,model_answer,question,correct_answer,time,category"]
    want = {}
    for i in range(2000):
        extra = [f" part {j} of {i} " for j in range(i % 4)]
        lines += [f"{i},A,start {i}", *extra, f"end,B,{i}.5,c"]
        want[i] = " ".join([f"start {i}", *[e.strip() for e in extra], "end"])
    (tmp_path / "big.csv").write_text("\n".join(lines))
    (tmp_path / "small.csv").write_text("\n".join(lines[:3]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        rows = repair_wrapped_records(spark, [str(tmp_path / "big.csv"), str(tmp_path / "small.csv")])
        big = rows.where(F.col("file").endswith("big.csv")).collect()
        assert rows.where(F.col("file").endswith("small.csv")).count() == 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {r.QID: r.question for r in big} == want
    assert all(r.time == r.QID + 0.5 for r in big)


def test_summaries(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Model used: org/one-7b \nAccuracy: 61.5%\nAverage time: 2.25s\n")
    (tmp_path / "b.txt").write_text("Model used: two\nAverage time: 1.0s\n")
    (tmp_path / "c.txt").write_text("x\nModel used: three\nAccuracy: 70%\nAverage time: 0.5s")
    rows = parse_run_summaries(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in rows] == [("three", 70.0, 0.5), ("org/one-7b", 61.5, 2.25)]


def test_run_logs_with_quoted_lines(spark, tmp_path):
    folder = tmp_path / "qwen 7b"
    folder.mkdir()
    (folder / "log.csv").write_text(
        "ID,Problem,Model Response,Extracted Answer,Ground Truth,Correct,Latency,Category,Input Tokens,Output Tokens\n"
        '7,"two\nlines, one ""quote""",text,A,A,True,1.25,law,10,20\n'
    )
    row = read_run_logs(spark, str(folder), required=["ID", "Latency"]).first()
    assert (row.model, row.id, row.question) == ("qwen 7b", "7", 'two\nlines, one "quote"')
    assert (row.correct, row.latency, row.input_tokens, row.output_tokens) == ("True", 1.25, 10, 20)
    with pytest.raises(ValueError, match="missing columns"):
        read_run_logs(spark, str(folder), required=["Level"])


HEAD = "ID,Problem,Model Response,Extracted Answer,Ground Truth,Correct,Latency,Input Tokens,Output Tokens"


def test_run_logs_go_by_the_names_in_each_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEAD + ",Subject\n1,q,r,A,B,False,1.5,10,20,law\n")
    (tmp_path / "b.csv").write_text("\ufeff" + HEAD.replace("ID", "Unique ID") + "\r\nx/2,q,r,A,B,True,2.5,30,40\r\n")
    rows = {r.id: r for r in read_run_logs(spark, str(tmp_path)).collect()}
    assert (rows["1"].category, rows["1"].input_tokens, rows["1"].output_tokens) == ("law", 10, 20)
    assert (rows["x/2"].category, rows["x/2"].latency, rows["x/2"].correct) == (None, 2.5, "True")


@pytest.mark.parametrize("header", [HEAD + ",Colour", HEAD.replace(",Latency", ""), HEAD + ",Unique ID"])
def test_other_headers_are_refused(spark, tmp_path, header):
    (tmp_path / "a.csv").write_text(header + "\n" + ",".join("1" for _ in header.split(",")) + "\n")
    with pytest.raises(ValueError, match="columns"):
        read_run_logs(spark, str(tmp_path))


def test_broken_records_fail(spark, tmp_path):
    (tmp_path / "a.csv").write_text("QID,model_answer,question,correct_answer,time,category\n1,A,no more\n")
    with pytest.raises(Exception, match="cannot split"):
        repair_wrapped_records(spark, str(tmp_path)).collect()


def test_scratch_paths_are_new(spark):
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert a != b and a.startswith(shared_dir(spark))
