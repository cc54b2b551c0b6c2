"""The shape of plans, not their results."""

import re

import pytest
from pyspark.sql import functions as F

from cfgveil import BUILTIN
from cfgveil.operators import accounts as acc
from cfgveil.operators import archives as arc
from cfgveil.operators import detect as det
from cfgveil.operators import report as rep
from cfgveil.operators import sanitize as san
from cfgveil.plans import fixtures as fx

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_filters_do_not_multiply_through_the_chain(texts):
    done = san.sanitize(texts(["x"]), personal=["a"])
    plain = len(optimized(done))
    filtered = optimized(done.filter("modified and change_count > 1").select("path", "sanitized"))
    assert len(filtered) < 2 * plain
    assert filtered.count("Project") <= len(BUILTIN.rules) + 20


def test_only_needed_columns_are_read(spark):
    text = plan(rep.secrets_by_type(san.sanitize(fx.configs(spark, SF))))
    assert "ReadSchema: struct<c_custkey:bigint,c_name:string>" in text


def test_sanitizing_needs_no_shuffle(spark):
    docs = fx.table(spark, SF, "documents").selectExpr("doc_id as path", "text as content")
    assert "Exchange" not in plan(san.sanitize(docs))
    assert "Exchange" not in plan(det.detect_secrets(docs, ["path"]))


def test_no_cross_joins(spark):
    configs = fx.configs(spark, SF, "path", "content")
    accounts = acc.accounts_frame(spark, ["john.doe"], ["admin"])
    for df in (acc.account_occurrences(configs, accounts), acc.pseudonyms(acc.username_lines(configs, BUILTIN.rules[1]), accounts)):
        assert "NestedLoop" not in plan(df) and "Cartesian" not in plan(df)


def test_previews_are_limited_before_the_shuffle(spark):
    members = fx.configs(spark, SF, "archive", "member")
    assert "WindowGroupLimit" in plan(arc.member_preview(members))


def test_distinct_files_are_counted_in_two_steps(spark):
    text = plan(rep.secrets_by_type(san.sanitize(fx.configs(spark, SF))))
    assert re.search(r"hashpartitioning\(label#\d+, filename#\d+", text)


def test_archives_are_opened_once(spark):
    packed = arc.repack_archives(fx.configs(spark, SF, "archive", "member", "content"), "zip").select(F.col("archive").alias("path"), "content")
    text = optimized(arc.archive_info(arc.expand_archives(packed)))
    assert text.count("FlatMapGroupsInPandas") == 1 and text.count("MapInPandas") == 1


def test_a_report_reads_its_results_once(spark):
    done = san.sanitize(fx.configs(spark, SF, "path", "filename", "archive", "content")).select("archive", "path", "filename", "modified", "change_count", "findings")
    text = plan(rep.security_report(done, "now"))
    assert text.count("FileScan parquet") == 1 and "Join" not in text


def test_shared_folder_is_named_or_refused():
    from types import SimpleNamespace

    from cfgveil.session import shared_dir

    def session(master, conf, checkpoints=None):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: checkpoints)
        return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d: conf.get(k, d), set=conf.__setitem__))

    assert shared_dir(session("yarn", {"spark.checkpoint.dir": "hdfs:///a/"}, "hdfs:///b")) == "hdfs:///a"
    assert shared_dir(session("yarn", {}, "hdfs:///b/")) == "hdfs:///b"
    conf = {}
    assert shared_dir(session("local[2]", conf)) == shared_dir(session("local[2]", conf)) == conf["cfgveil.scratch.dir"]
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(session("spark://host:7077", {}))
