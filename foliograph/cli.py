"""Command line: export-schema, detect, parse and evaluate-ingestion."""

from __future__ import annotations

import argparse
import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph import schema
from foliograph.operators import enrich, metrics
from foliograph.sources import docx, files, latex

ANNOTATION = "source_format string, language string, headings array<array<string>>, sections array<string>, citations array<string>, references array<struct<year:int,doi:string,first_author:string>>, figures int, tables int, code_blocks int, excluded_kinds array<string>"
PLAIN = ["doc_id", "ordinal", "block_id", "type", "level", "text", "start", "end", "page", "flags"]


def parse(spark: SparkSession, path: str) -> tuple[enrich.Enriched, DataFrame]:
    """(tables, quarantine) of all files below a path. A LaTeX file is a project of its own; use parse_projects for folders."""
    accepted, refused = files.guarded(files.scan(spark, path))
    raw = docx.raw_rows(accepted.filter("source_format = 'docx'"))
    tex = latex.raw_rows(accepted.filter("source_format = 'latex'").select("doc_id", F.col("filename").alias("path"), files.decoded("content").alias("content")))
    return parsed(raw, tex), refused


def parsed(docx_rows: DataFrame, latex_rows: DataFrame) -> enrich.Enriched:
    """Enrich raw rows of both formats in one plan."""
    units = latex.blocks(latex_rows)
    known = latex.refs(latex_rows)
    both = docx.classified(docx_rows).select(*PLAIN).unionByName(units.select(*PLAIN))
    return enrich.enrich(both, known_refs=known, known_citations=latex.citations(units, known))


def document_ir(e: enrich.Enriched) -> DataFrame:
    """One nested row a document."""
    out = e.languages
    for name, df in (("blocks", e.blocks), ("sections", e.sections), ("citations", e.citations), ("references", e.refs), ("floats", e.floats), ("exclusion_mask", e.exclusions)):
        rows = df.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*(c for c in (["ordinal"] if "ordinal" in df.columns else []) + [x for x in df.columns if x not in ("doc_id", "ordinal")])))).alias(name))
        out = out.join(rows, "doc_id", "left")
    return out.withColumn("schema_version", F.lit(schema.VERSION))


def evaluate(e: enrich.Enriched, expected: DataFrame) -> DataFrame:
    """A report row for each document. expected: doc_id and the fields of ANNOTATION."""
    x = expected
    heading = F.transform(F.coalesce("headings", F.array()), lambda h: F.concat_ws("@", metrics.metric_key(h[0]), F.coalesce(h[1], F.lit("0"))))
    cited = F.transform(F.coalesce("citations", F.array()), lambda c: F.when(F.col("source_format") == "latex", metrics.metric_key(c)).otherwise(F.lower(F.regexp_replace(c, r"(?U)\s+", ""))))
    parts = {
        "heading": (metrics.heading_keys(e.blocks), x.select("doc_id", F.explode(heading).alias("key"))),
        "section": (e.sections.select("doc_id", F.col("kind").alias("key")), x.select("doc_id", F.explode("sections").alias("key"))),
        "citation": (metrics.citation_keys(e.citations), x.select("doc_id", F.explode(cited).alias("key"))),
    }
    out = x.select("doc_id", "source_format", F.col("language").alias("language_expected"), *(F.coalesce(c, F.lit(0)).alias(f"{c}_expected") for c in ("figures", "tables", "code_blocks")))
    for name, (got, want) in parts.items():
        score = metrics.multiset_prf(got, want, ["doc_id"])
        out = out.join(score.select("doc_id", *(F.col(c).alias(f"{name}_{c}") for c in ("precision", "recall", "f1"))), "doc_id", "left")
    asked = x.select("doc_id", F.posexplode("references").alias("expectation_id", "r")).select("doc_id", "expectation_id", "r.*")
    out = out.join(metrics.matched_references(asked, e.refs).select("doc_id", F.col("accuracy").alias("reference_accuracy")), "doc_id", "left").fillna(1.0, ["reference_accuracy"])
    found = e.floats.groupBy("doc_id").agg(F.count_if(F.col("kind") == "figure").alias("figures_found"), F.count_if(F.col("kind") == "table").alias("tables_found"))
    out = out.join(found, "doc_id", "left").fillna(0, ["figures_found", "tables_found"]).join(e.languages, "doc_id", "left")
    kinds = e.exclusions.groupBy("doc_id").agg(F.array_sort(F.collect_set("reason")).alias("excluded_kinds_found"))
    return out.join(kinds, "doc_id", "left").withColumn("language_correct", F.col("language_primary").eqNullSafe(F.col("language_expected"))).withColumn("runtime_s", F.lit(0.0))


def main(argv: list[str] | None = None) -> int:
    from foliograph.session import local_session

    p = argparse.ArgumentParser(prog="foliograph")
    sub = p.add_subparsers(dest="command", required=True)
    for name, help_ in (("export-schema", "write the tables' schema"), ("detect", "print each file's format"), ("parse", "write documents as JSON"), ("evaluate-ingestion", "score a corpus with annotations")):
        c = sub.add_parser(name, help=help_)
        if name != "export-schema":
            c.add_argument("path")
        c.add_argument("--out")
    a = p.parse_args(argv)
    spark = local_session()
    if a.command == "export-schema":
        text = schema.export_schema()
        open(a.out, "w").write(text) if a.out else print(text)
    elif a.command == "detect":
        files.detect(files.scan(spark, a.path)).select("filename", "source_format").show(1000, False)
    elif a.command == "parse":
        e, refused = parse(spark, a.path)
        document_ir(e).write.mode("overwrite").json(a.out or "foliograph-out")
        refused.write.mode("overwrite").json(f"{a.out or 'foliograph-out'}-quarantine")
    else:
        entries = files.corpus(spark, a.path)
        e, _ = parse(spark, a.path)
        ids = files.scan(spark, a.path).select("doc_id", "path")
        expected = entries.join(ids, "path").select("doc_id", F.from_json("annotation", ANNOTATION).alias("x")).select("doc_id", "x.*")
        report = evaluate(e, expected)
        body = {"generated_at": datetime.now(timezone.utc).isoformat(), "summary": [r.asDict() for r in metrics.summarise(report).collect()], "documents": [r.asDict(True) for r in report.collect()]}
        text = json.dumps(body, indent=2, ensure_ascii=False, default=str)
        open(a.out, "w").write(text) if a.out else print(text)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
