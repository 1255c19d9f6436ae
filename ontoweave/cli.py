"""Commands: ``python -m ontoweave.cli <command> ...``.

extract, report, eval, calibrate, eval-spans, export-cypher, graph, init-ontology, validate-ontology, probe.
"""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import evaluate, export, ontology, parsing
from .operators.decide import Gate
from .plans import benchmark
from .plans.pipeline import Extraction, extract
from .session import get_session, ship
from .sources import files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ontoweave", description=__doc__)
    commands = p.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: str, **options: str) -> argparse.ArgumentParser:
        c = commands.add_parser(name)
        for a in arguments:
            c.add_argument(a)
        for o, default in options.items():
            c.add_argument(f"--{o.replace('_', '-')}", default=default)
        return c

    for name in ("extract", "report", "graph", "export-cypher"):
        command(name, "notes", ontology="trade", out="", gate="", title="Graph")
    command("eval", "notes", "labels", ontology="trade", gate="", groups="")
    command("calibrate", "notes", "labels", ontology="trade", out="", max_error="0.15")
    command("eval-spans", "split", ontology="trade", prefix="test", maps="", limit="")
    command("init-ontology", "path")
    command("validate-ontology", "ontology")
    command("probe", "notes")
    return p


def _gate(path: str) -> Gate:
    return Gate(**json.loads(Path(path).read_text())) if path else Gate()


def _extract(spark: SparkSession, args: argparse.Namespace) -> tuple[Extraction, ontology.Ontology]:
    onto = ontology.load(args.ontology)
    return extract(files.read_notes(spark, args.notes), onto, gate=_gate(getattr(args, "gate", ""))), onto


def _labels(spark: SparkSession, args: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    """(notes, labels that have one); labels without a note are named."""
    notes = files.read_notes(spark, args.notes)
    gold, alone = files.pair_gold(files.read_gold(spark, args.labels), notes)
    for row in alone.select("document_id").toLocalIterator():
        print(f"no note for the labels of {row.document_id}", file=sys.stderr)
    return notes, gold.select("document_id", "entities", "relations")


def run(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "init-ontology":
        print(ontology.write_starter(args.path))
        return 0
    if args.command == "validate-ontology":
        try:
            print(json.dumps(ontology.load(args.ontology).describe(), indent=2))
        except (ontology.OntologyError, FileNotFoundError) as problem:
            print(problem, file=sys.stderr)
            return 1
        return 0
    spark = get_session()
    ship(spark)
    if args.command == "probe":
        parsing.sentences(files.read_notes(spark, args.notes)).groupBy("document_id").agg(F.count(F.lit(1)).alias("sentences")).show(truncate=False)
    elif args.command == "extract":
        x, _ = _extract(spark, args)
        rows = export.result_json(x.entities, x.relationships, x.items, x.mentions, x.statistics())
        if args.out:
            rows.write.mode("overwrite").json(args.out)
        else:
            for row in rows.toLocalIterator():
                print(row.result_json)
    elif args.command == "export-cypher":
        x, _ = _extract(spark, args)
        files.write_statements(export.cypher(x.entities, x.relationships), args.out or "cypher")
    elif args.command == "graph":
        x, onto = _extract(spark, args)
        export.write_pages(export.graph_pages(*export.cap_graph(*export.web_graph(x.entities, x.relationships, x.items, x.sentences, onto)), args.title), args.out or "graph")
    elif args.command == "report":
        x, onto = _extract(spark, args)
        export.write_pages(export.report_pages(files.read_notes(spark, args.notes), x.typed, x.entities, x.relationships, x.items, onto, args.title), args.out or "report")
    elif args.command == "eval":
        notes, gold = _labels(spark, args)
        groups = {args.ontology: (ontology.load(args.ontology), None)}
        for other, ids in (g.split("=", 1) for g in args.groups.split(";") if g):
            groups[other] = (ontology.load(other), ids.split(","))
        scores = benchmark.score_notes(notes, gold, groups, gate=_gate(args.gate))
        for row in scores.summary.orderBy("what", "group").toLocalIterator():
            print(json.dumps(row.asDict()))
        print(json.dumps({"seconds": round(scores.seconds, 2)}))
    elif args.command == "calibrate":
        notes, gold = _labels(spark, args)
        x, _ = _extract(spark, args)
        keys = gold.select("document_id", F.explode("entities").alias("e")).select("document_id", evaluate.entity_key(F.col("e.name"), F.col("e.type")).alias("k"), F.lit(True).alias("ok")).distinct()
        rows = x.typed.withColumn("k", evaluate.entity_key(F.col("text"), F.col("entity_type"))).join(keys, ["document_id", "k"], "left")
        rows = rows.select(F.lit("all").alias("g"), F.col("winner_prob").alias("prob"), F.coalesce("ok", F.lit(False)).alias("correct"), F.concat_ws(":", "document_id", "d_ord").alias("ord"))
        fit = evaluate.fit_gate(evaluate.curve(rows, ["g"]), ["g"], float(args.max_error)).first()
        gate = asdict(Gate(accept_prob=fit.accept_prob, reject_prob=fit.reject_prob, fitted=True)) if fit else asdict(Gate())
        Path(args.out or "gate.json").write_text(json.dumps(gate, indent=2))
    elif args.command == "eval-spans":
        maps = json.loads(Path(args.maps).read_text()) if args.maps else {"types": {}, "relations": {}}
        docs = files.read_token_split(spark, args.split, args.prefix)
        scores = benchmark.run_split(docs, ontology.load(args.ontology), maps["types"], maps["relations"], capitals=True, limit=int(args.limit) if args.limit else None)
        for row in scores.summary.toLocalIterator():
            print(json.dumps(row.asDict()))
        print(json.dumps({"seconds": round(scores.seconds, 2)}))
    return 0


if __name__ == "__main__":
    sys.exit(run())
