"""What a discovery report says, in each of its forms."""

import json

from tidelake.plans import report


def test_sections(spark):
    mined = spark.createDataFrame([("a", "c", ">", 80, 61.25, 40, 0.7, 0.01, 1, 0.7), ("a", "v", "<", 20, 9.0, 25, 0.3, -0.02, -1, 0.7), ("b", "c", "<", 10, 12.5, 30, 0.9, 0.03, 1, 0.9)], "sym string, indicator string, op string, pct int, threshold double, support long, win double, mean double, direction int, confidence double")
    critic = spark.createDataFrame([("a", "c>80", "CREDIBLE"), ("b", "c<10", "DEBUNKED"), ("b", "other", "SUSPICIOUS")], "sym string, rule string, verdict string")
    tables = {"prices": (spark.createDataFrame([(60,), (120,)], "t long").selectExpr("timestamp_seconds(t) as ts"), "ts"), "empty": (spark.createDataFrame([], "x int"), None)}
    scores = spark.createDataFrame([("f1", 0.1, 0.2, 0.3, 0.4, 0.9, 1), ("f2", 0.0, 0.1, 0.2, None, 0.2, 2)], "feature string, corr double, mi double, perm double, shap double, score double, rank int")
    text, page, body = report.discovery("D", {"data": report.acquisition(tables), "rules": report.entry_rules(mined, critic), "critic": report.critic_summary(critic), "features": report.feature_summary(scores), "patterns": critic.limit(0)})
    said = json.loads(body)["sections"]
    assert said["data"] == [{"source": "empty", "rows": 0, "start": None, "end": None}, {"source": "prices", "rows": 2, "start": 60, "end": 120}]
    assert [(r["sym"], r["rule"], r["direction"], r["verdict"]) for r in said["rules"]] == [("b", "c < 12.5000", "LONG", "DEBUNKED"), ("a", "c > 61.2500", "LONG", "CREDIBLE"), ("a", "v < 9.0000", "SHORT", "UNKNOWN")]
    assert said["critic"] == [{"rules": 3, "credible": 1, "suspicious": 1, "debunked": 1, "credible_share": 1 / 3}]
    assert [f["feature"] for f in said["features"]] == ["f1", "f2"] and said["patterns"] == []
    assert "  sym: a, rule: v < 9.0000, direction: SHORT, support: 25, win: 0.3000, confidence: 0.7000, verdict: UNKNOWN" in text.split("\n")
    assert text.count("\n  none") == 1 and "  rank: 2, feature: f2, score: 0.2000, shap: , perm: 0.2000, mi: 0.1000, corr: 0.0000" in text
    assert "<td>c &lt; 12.5000</td>" in page and page.count("<table>") == 4
    assert report.critic_summary(critic.limit(0)).first().credible_share == 0.0
