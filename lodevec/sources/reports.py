"""Reports as JSON, CSV, Markdown or HTML, the shapes of a campaign's tables, and configurations with declared fields."""

from __future__ import annotations

import csv
import html
import io
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodevec.sources.files import read_text, write_text


# ---------------------------------------------------------------------- configurations
@dataclass(frozen=True)
class Field:
    """A field of a configuration by its dotted path, what it must be, and the test for that."""

    path: str
    wanted: str
    holds: Callable[[Any], bool]

    def complaint(self, config: dict) -> str | None:
        value: Any = config
        for step in self.path.split("."):
            if not isinstance(value, dict) or step not in value:
                return f"{self.path} isn't there"
            value = value[step]
        return None if self.holds(value) else f"{self.path} is {value!r} and not {self.wanted}"


def _any(path: str) -> Field:
    return Field(path, "anything", lambda _: True)


def _filled(path: str) -> Field:
    return Field(path, "filled", bool)


def _count(path: str) -> Field:
    return Field(path, "a whole number from 1 on", lambda v: str(v).lstrip("+").isdigit() and int(v) > 0)


def _one_of(path: str, *names: str) -> Field:
    return Field(path, " or ".join(names), lambda v: v in names)


#: The fields that a configuration of each kind must have.
CONFIGS = {
    "dataset": [
        _any("dataset_id"), _any("display_name"), _any("source.kind"), _any("source.split"), _count("retrieval_profile.top_k_default"), _any("evidence.enabled"), _any("answer_metrics"),
        _filled("stable_passage_id_fields"),
    ],
    "regression": [_one_of("harness", "beir", "lotte"), _any("dataset_id"), _count("top_k"), _any("metric")],
    "campaign": [_any("datasets"), _any("generator_id")],
}


def check_config(config: dict, kind: str) -> dict:
    """The configuration itself; raises with all that is wrong with it."""
    wrong = [c for field in CONFIGS[kind] if (c := field.complaint(config))]
    if wrong:
        raise ValueError(f"can't use this {kind} configuration: " + "; ".join(wrong))
    return config


def read_config(spark: SparkSession, path: str, kind: str) -> dict:
    return check_config(json.loads(read_text(spark, path)), kind)


def fixture_queries(spark: SparkSession, queries: Sequence[dict]) -> DataFrame:
    """Queries of a fixture file: ``(query_id, query_text, embedding, relevant)``; numbers as ids become texts."""
    lines = spark.createDataFrame([(json.dumps(q),) for q in queries], "line string")
    read = lines.select(F.from_json("line", "query_id string, query_text string, query_vector array<double>, relevant_ids array<string>").alias("q"))
    return read.select("q.query_id", "q.query_text", F.col("q.query_vector").alias("embedding"), F.col("q.relevant_ids").alias("relevant"))


# ---------------------------------------------------------------------- shapes
#: Columns of each table of a report, as far as its rows have them; others follow.
SHAPES = {
    "retrieval": ["dataset", "system_id", "query_count", "recall", "mrr", "ndcg", "hit_rate", "evidence_coverage", "p50_ms", "p95_ms", "p99_ms", "qps", "index_bytes"],
    "two_stage": ["dataset", "method", "recall_before", "recall_after", "recall_gain", "ndcg_before", "ndcg_after", "added_ms"],
    "answers": ["dataset", "system_id", "generator_id", "exact_match", "f1", "prompt_tokens", "context_tokens", "generator_ms"],
    "diagnostics": ["dataset", "system_id", "mode", "score_mode", "probes", "visited_code_fraction", "visited_page_fraction"],
    "comparisons": ["dataset", "candidate", "baseline", "metric", "candidate_value", "baseline_value", "difference", "ratio"],
    "leaders": ["dataset", "metric", "system_id", "value"],
}


def shaped(df: DataFrame, kind: str) -> DataFrame:
    """The rows in the order of columns that a report of this kind has, sorted by its first two."""
    first = [c for c in SHAPES[kind] if c in df.columns]
    return df.select(*first, *(c for c in df.columns if c not in first)).orderBy(*first[:2])


def two_stage(rows: DataFrame, approx: str = "_approx", rerank: str = "_rerank") -> DataFrame:
    """What reranking changes: a row a dataset and method, of retrieval rows whose systems end in these."""

    def stage(ending: str, name: str) -> DataFrame:
        of = rows.where(F.col("system_id").endswith(ending))
        method = F.substr("system_id", F.lit(1), F.length("system_id") - len(ending))
        return of.select("dataset", method.alias("method"), *(F.col(c).alias(f"{c}_{name}") for c in ("recall", "ndcg", "p50_ms")))

    both = stage(approx, "before").join(stage(rerank, "after"), ["dataset", "method"])
    gain = F.round(F.col("recall_after") - F.col("recall_before"), 6) + F.lit(0.0)
    added = F.round(F.col("p50_ms_after") - F.col("p50_ms_before"), 3)
    return shaped(both.withColumns({"recall_gain": gain, "added_ms": added}).drop("p50_ms_before", "p50_ms_after"), "two_stage")


# ---------------------------------------------------------------------- writing
def _rows(df: DataFrame) -> tuple[list[str], list[list]]:
    """A report's rows; a report has a row a system or dataset, never one a query."""
    return df.columns, [list(r) for r in df.collect()]


def as_json(df: DataFrame) -> str:
    names, rows = _rows(df)
    return json.dumps([dict(zip(names, r, strict=True)) for r in rows], indent=2, default=str)


def as_csv(df: DataFrame) -> str:
    names, rows = _rows(df)
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerows([names, *rows])
    return out.getvalue()


def _shown(value: object) -> str:
    return "" if value is None else f"{value:.4f}" if isinstance(value, float) else str(value)


def as_markdown(df: DataFrame, title: str, level: int = 1) -> str:
    names, rows = _rows(df)
    line = lambda cells: "| " + " | ".join(c.replace("|", "\\|") for c in cells) + " |"
    return "\n".join(["#" * level + f" {title}", "", line(names), line(["---"] * len(names)), *(line([_shown(v) for v in r]) for r in rows), ""])


def as_html(tables: dict[str, DataFrame], title: str) -> str:
    parts = [f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>"]
    for name, df in tables.items():
        names, rows = _rows(df)
        head = "".join(f"<th>{html.escape(n)}</th>" for n in names)
        body = "".join("<tr>" + "".join(f"<td>{html.escape(_shown(v))}</td>" for v in r) + "</tr>" for r in rows)
        parts.append(f"<h2>{html.escape(name)}</h2><table><tr>{head}</tr>{body}</table>")
    return "".join([*parts, "</body></html>"])


def write_report(df: DataFrame, path: str, title: str = "Report") -> None:
    """Write one file; its ending says which kind."""
    kind = path.rpartition(".")[2]
    text = {"json": as_json, "csv": as_csv}[kind](df) if kind in ("json", "csv") else as_markdown(df, title) if kind == "md" else as_html({title: df}, title)
    write_text(df.sparkSession, path, text)


def write_tables(tables: dict[str, DataFrame], folder: str, title: str, facts: dict | None = None) -> list[str]:
    """A report of several tables: each as CSV, all as JSON with ``facts`` beside them, as Markdown and as HTML; gives the files' names."""
    folder = folder.rstrip("/")
    spark = next(iter(tables.values())).sparkSession
    whole = {name: json.loads(as_json(df)) for name, df in tables.items()}
    out = {f"{name}.csv": as_csv(df) for name, df in tables.items()}
    out["report.json"] = json.dumps({**(facts or {}), "tables": whole}, indent=2, default=str)
    out["report.md"] = f"# {title}\n\n" + "\n".join(as_markdown(df, name, 2) for name, df in tables.items())
    out["report.html"] = as_html(tables, title)
    for name, text in out.items():
        write_text(spark, f"{folder}/{name}", text)
    return sorted(out)
