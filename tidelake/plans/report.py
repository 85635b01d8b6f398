"""Reports from collected metric rows (one row per rule or series): text, HTML and JSON."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.sources.store import to_json


def rows(df: DataFrame, most: int = 100_000) -> list[dict]:
    """Metric rows as plain values; more than ``most`` are no report and raise an error."""
    found = df.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a report holds {most} rows at most; aggregate or rank them first")
    return [r.asDict(recursive=True) for r in found]


def text(title: str, sections: dict[str, list[dict]]) -> str:
    out = [title, "=" * len(title)]
    for name, data in sections.items():
        out += ["", name, "-" * len(name)]
        out += ["  " + ", ".join(f"{k}: {_show(v)}" for k, v in r.items()) for r in data] or ["  none"]
    return "\n".join(out)


def page(title: str, sections: dict[str, list[dict]]) -> str:
    body = [f"<h1>{html.escape(title)}</h1>"]
    for name, data in sections.items():
        body.append(f"<h2>{html.escape(name)}</h2>")
        if data:
            body.append("<table><tr>" + "".join(f"<th>{html.escape(k)}</th>" for k in data[0]) + "</tr>")
            body += ["<tr>" + "".join(f"<td>{html.escape(_show(v))}</td>" for v in r.values()) + "</tr>" for r in data]
            body.append("</table>")
    return "<!doctype html><meta charset=utf-8>" + "\n".join(body)


def as_json(title: str, sections: dict[str, list[dict]]) -> str:
    return to_json({"title": title, "sections": sections})


def _show(v) -> str:
    return "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)


def exit_fields(df: DataFrame, name: str) -> DataFrame:
    """Stop, take and bars from rule names like ``exit_sl2_tp3_24h``; other names give nulls."""
    pattern = r"sl([\d.]+)_tp([\d.]+)_(\d+)h"
    part = lambda k, kind: F.regexp_extract(name, pattern, k).try_cast(kind)
    return df.select("*", part(1, "double").alias("stop"), part(2, "double").alias("take"), part(3, "int").alias("bars"))


def cards(df: DataFrame, fields: tuple[str, ...] = ("rule", "n", "mean", "verdict")) -> DataFrame:
    """``card``: a strategy in a few lines, one for each field; unknown values are empty."""
    shown = {c: F.format_string("%.4f", F.col(c)) if t in ("double", "float") else F.col(c).cast("string") for c, t in df.dtypes if c in fields}
    lines = [F.concat(F.lit(f"{k:>12}: "), F.coalesce(shown.get(k, F.lit("")), F.lit(""))) for k in fields]
    return df.withColumn("card", F.concat_ws("\n", *lines))


# sections of a discovery report, each one frame of bounded size
def acquisition(tables: dict[str, tuple[DataFrame, str | None]]) -> DataFrame:
    """source, rows, start, end (of its time column, if it has one, in epoch seconds), one row a table, by name."""
    parts = []
    for name, (df, time) in sorted(tables.items()):
        at = F.unix_timestamp(F.col(time).cast("timestamp")) if time else F.lit(None).cast("long")
        parts.append(df.agg(F.count("*").alias("rows"), F.min(at).alias("start"), F.max(at).alias("end")).select(F.lit(name).alias("source"), "rows", "start", "end"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("source")


def entry_rules(mined: DataFrame, critic: DataFrame | None = None, most: int = 50) -> DataFrame:
    """The best rules of a search (``search.mine``) with their side and what the critic (sym, rule, verdict) says; unknown to it: UNKNOWN."""
    rule = F.concat("indicator", F.lit(" "), "op", F.lit(" "), F.format_string("%.4f", "threshold"))
    rows = mined.orderBy(F.desc("confidence"), F.desc("support"), "sym", "indicator", "op", "pct").limit(most)
    rows = rows.select("sym", rule.alias("rule"), F.when(F.col("direction") > 0, "LONG").otherwise("SHORT").alias("direction"), "support", "win", "confidence", F.concat("indicator", "op", F.col("pct").cast("string")).alias("name"))
    if critic is not None:
        rows = rows.join(critic.select("sym", F.col("rule").alias("name"), "verdict"), ["sym", "name"], "left")
    verdict = F.coalesce("verdict", F.lit("UNKNOWN")) if critic is not None else F.lit("UNKNOWN")
    return rows.select("sym", "rule", "direction", "support", "win", "confidence", verdict.alias("verdict")).orderBy(F.desc("confidence"), F.desc("support"), "sym", "rule")


def critic_summary(verdicts: DataFrame) -> DataFrame:
    """Rules judged, by verdict, and the share that is credible."""
    of = lambda v: F.count_if(F.col("verdict") == v)
    return verdicts.agg(F.count("*").alias("rules"), of("CREDIBLE").alias("credible"), of("SUSPICIOUS").alias("suspicious"), of("DEBUNKED").alias("debunked"), F.coalesce(F.try_divide(of("CREDIBLE"), F.count("*")), F.lit(0.0)).alias("credible_share"))


def feature_summary(scores: DataFrame, most: int = 50) -> DataFrame:
    """The best features by rank, with each part of their score."""
    return scores.orderBy("rank").limit(most).select("rank", "feature", "score", "shap", "perm", "mi", "corr")


def discovery(title: str, sections: dict[str, DataFrame]) -> tuple[str, str, str]:
    """The report of several sections as text, HTML and JSON; each section is collected once."""
    data = {name: rows(df) for name, df in sections.items()}
    return text(title, data), page(title, data), as_json(title, data)
