import math

import pytest

from crawlq.operators import domains

GOLDEN = [
    ("google.com", 1.0, 0.5),
    ("xjwq-kd.net", 0.0, 0.0),
    ("a.com", 1.0000000000000001e307, 1.0),
    ("localhost", 0.0, 0.0),
    ("WWW.Eo.org", 0.25, 0.2),
    ("aeiouaeiouaeiouaei.com", math.inf, 1.0),
    ("", 0.0, 0.0),
]


@pytest.mark.parametrize("host, nonvowel, total", GOLDEN)
def test_scores(spark, host, nonvowel, total):
    row = domains.dga_scores(spark.createDataFrame([(host,)], "host string")).first()
    assert (row.ratio_nonvowel, row.ratio_total) == (nonvowel, total)


def test_summary_counts_hosts_once(spark):
    hosts = spark.createDataFrame([("bcd.com",), ("bcd.com",), ("aei.com",)], "host string")
    row = domains.dga_site_summary(hosts, 0.3).first()
    assert (row.suffix, row.n_hosts, row.n_suspect) == ("com", 2, 1)
    assert [r.host for r in domains.dga_lowest(hosts, 1).collect()] == ["bcd.com"]
