"""Suffix rates that do not give a URL's own label away, and the bound of the training rows."""

import random

import pytest
from pyspark.sql import functions as F

from cohortlens.llm import queries, url_filter

SF = "/root/testdata/sf0.01"


def held_out_accuracy(spark, site, n=4_000):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        depth = rng.randint(1, 6)
        label = int(depth > 3) if rng.random() > 0.1 else int(depth <= 3)
        rows.append((i, f"http://{site(i)}/" + "/".join(rng.choice("abcdef") * 3 for _ in range(depth)), label))
    pages = spark.createDataFrame(rows, "page_id bigint, url string, label int")
    known = pages.where("page_id % 4 <> 0").select("page_id", "label")
    out = url_filter.judge(pages.select("page_id", "url"), (), known).join(pages.select("page_id", "label"), "page_id")
    right = F.avg(((F.col("verdict") == "block") == (F.col("label") == 1)).cast("double"))
    return out.groupBy((F.col("page_id") % 4 == 0).alias("held_out")).agg(right.alias("right")).orderBy("held_out").collect()


@pytest.mark.parametrize("site", [lambda i: "one.org", lambda i: f"s{i}.org"], ids=["common site", "a site per URL"])
def test_depth_is_learned_whatever_the_sites(spark, site):
    trained, held_out = (r["right"] for r in held_out_accuracy(spark, site))
    assert held_out >= 0.85 and trained <= held_out + 0.06


def test_a_hot_url_and_repeated_rows(spark):
    rows = [(i, "http://hot.net/x/y?q=1") for i in range(2_000)] + [(i, f"http://s{i}.com/a/{i}") for i in range(2_000, 4_000)]
    rows += rows[:3] + [(None, None), (None, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    labels = pages.select("page_id", F.when(F.col("page_id") < 2_000, 1).otherwise(0).alias("label")).where("page_id % 10 <> 0")
    got = url_filter.judge(pages, (), labels, train_rows=500).collect()
    assert len(got) == len(rows)
    assert sum(r["verdict"] == ("block" if r["page_id"] is not None and r["page_id"] < 2_000 else "allow") for r in got) >= 0.99 * len(rows)


def test_the_query_equals_the_rules_written_out(spark):
    order = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    out = queries.op1(spark, SF).collect()
    assert len(out) == len(urls)
    for r in out:
        host = path = ""
        if urls[r["page_id"]] and "://" in urls[r["page_id"]]:
            rest = urls[r["page_id"]].split("://", 1)[1]
            end = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
            path = rest[end:]
            path = path[:min((path.index(c) for c in "?#" if c in path), default=len(path))]
        fits = [(len(h) + len(p), h + p, v) for h, p, v in order if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits) if fits else (0, None, r["verdict"])
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, *rule[1:])
