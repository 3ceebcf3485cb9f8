"""Commands over evidence sources: python -m tracewell COMMAND ...

Exit codes: 0 done, 1 failed, 3 needs review, 4 the format doesn't support the operation.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.bytesx import UNITS
from .operators import carry, channels, demux, detect, formats, frames, integrity, intervals, layout, rebuild, scan, storage
from .plans import corpus, triage
from .session import ready
from .sources import evidence, reports, sinks

OK, FAILED, REVIEW, UNSUPPORTED = 0, 1, 3, 4


def size(text: str) -> int:
    """Bytes of '4096', '0x1000' or '4 MiB'."""
    low = text.strip().lower()
    if low.startswith("0x"):
        return int(low, 16)
    number = low.rstrip("abcdefghijklmnopqrstuvwxyz").strip()
    total = float(number) * UNITS[low[len(low.rstrip("abcdefghijklmnopqrstuvwxyz")) :]]
    if total != int(total):
        raise ValueError(f"{text} is no whole number of bytes")
    return int(total)


def show(df: DataFrame) -> None:
    for row in df.toJSON().toLocalIterator():
        print(row)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tracewell", description=__doc__)
    commands = p.add_subparsers(dest="command", required=True)

    def add(name: str, source: bool = True) -> argparse.ArgumentParser:
        c = commands.add_parser(name)
        if source:
            c.add_argument("source", nargs="+", help="a file, or the members of a set")
            c.add_argument("--layout", choices=["file", "concat", "raid0"], default="file")
            c.add_argument("--stripe", type=size, default=65536)
            c.add_argument("--start", type=size, default=0)
            c.add_argument("--stop", type=size)
            c.add_argument("--chunk", type=size, default=4 << 20)
        return c

    add("inspect")
    add("triage").add_argument("--out")
    add("detect")
    add("formats", False)
    add("storage")
    hits = add("hitmap")
    hits.add_argument("--pattern", action="append", required=True, help="id=hex")
    hits.add_argument("--keep", type=int, default=16)
    add("samples").add_argument("--count", type=int, default=9)
    found = add("frames")
    found.add_argument("--loose", action="store_true")
    found.add_argument("--channels", action="store_true")
    found.add_argument("--most", type=int)
    add("boundaries").add_argument("--date", required=True)
    add("demux").add_argument("--out", required=True)
    places = add("layout")
    places.add_argument("--framing", required=True, help="a file with the record layout, see `framing`")
    places.add_argument("--size", type=size, action="append", required=True, help="a fragment size to try")
    places.add_argument("--top", type=int, default=8)
    whole = add("recover")
    whole.add_argument("--framing", required=True)
    whole.add_argument("--fragment", type=size, required=True)
    whole.add_argument("--data-offset", type=size, default=0)
    whole.add_argument("--date", required=True)
    whole.add_argument("--label", default="recording")
    whole.add_argument("--out", required=True)
    m = add("map", False)
    m.add_argument("mapfile")
    m.add_argument("--size", type=size)
    add("verify-audit", False).add_argument("log")
    v = add("validate", False)
    v.add_argument("manifest")
    v.add_argument("--root", required=True)
    return p


def framing(path: str) -> tuple[carry.Layout, dict[int, int], int, frozenset[int]]:
    """A record layout, the place of the time in records by type, the type that begins a recording, and the types with payload, of a JSON file.

    {"sync": "5258", "types": {"1": [16, 12, "<I"]}, "times": {"2": 8}, "begins": 2, "media": [1, 2], "most": 65536}; most is optional.
    """
    with open(path) as f:
        x = json.load(f)
    try:
        of = carry.Layout(bytes.fromhex(x["sync"]), {int(k): tuple(v) for k, v in x["types"].items()}, **({"most": x["most"]} if "most" in x else {}))
        return of, {int(k): v for k, v in x["times"].items()}, x["begins"], frozenset(x["media"])
    except (KeyError, TypeError) as e:
        raise ValueError(f"{path} is no record layout: {e}") from e


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = ready(spark or SparkSession.builder.appName("tracewell").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    try:
        return run(spark, a)
    except (OSError, ValueError) as e:
        print(f"failed: {e}", file=sys.stderr)
        return FAILED


def run(spark: SparkSession, a: argparse.Namespace) -> int:
    def chunks(overlap: int) -> DataFrame:
        options = {"layout": a.layout, "stripe": a.stripe, "start": a.start, "chunk": a.chunk, "overlap": overlap}
        return evidence.read(spark, a.source, **options, **({"stop": a.stop} if a.stop is not None else {}))

    space = (a.source, a.layout, a.stripe) if hasattr(a, "layout") else None

    def whole() -> int:
        with evidence.Space(*space) as opened:
            return opened.size

    known = [evidence.require_readable(s) for s in getattr(a, "source", ())]
    if a.command == "inspect":
        for x in known:
            print(json.dumps(x))
    elif a.command == "formats":
        show(formats.default().descriptors(spark))
    elif a.command == "triage":
        row = triage.triage(spark, a.source[0])
        if a.out:
            sinks.write_report(row, a.out)
        else:
            show(row)
        return REVIEW if row.first()["review"] else OK
    elif a.command == "detect":
        row = formats.default().report(chunks(64), space=space)
        show(row)
        first = row.first()
        return REVIEW if first is None or first["requires_review"] else OK
    elif a.command == "storage":
        head = chunks(0).where("chunk = 0").select("source", "data")
        show(storage.mbr(head))
        show(storage.gpt(head))
        show(storage.filesystems(spark, head.withColumn("base", F.lit(0))))
    elif a.command == "hitmap":
        patterns = [(i, bytes.fromhex(h)) for i, _, h in (x.partition("=") for x in a.pattern)]
        found = scan.signature_hits(chunks(max(len(p) for _, p in patterns) - 1), patterns, a.start, a.stop)
        show(scan.hit_stats(found, whole(), a.keep))
    elif a.command == "samples":
        n = whole()
        at = spark.range(1).select(F.explode(scan.sample_offsets(F.lit(n), min(a.chunk, 64 << 20), a.count)).alias("key")).collect()
        for r in at:
            show(scan.byte_profile(evidence.read(spark, a.source, layout=a.layout, stripe=a.stripe, start=r["key"], stop=r["key"] + a.chunk, chunk=a.chunk).select(F.col("base").alias("key"), "data")))
    elif a.command in ("frames", "boundaries", "demux"):
        if not formats.default().get("dhav").supports("demux" if a.command == "demux" else "scan_frames"):
            return UNSUPPORTED
        if a.command == "demux":
            show(demux.to_files(spark, space, a.out, start=a.start, stop=a.stop, chunk=a.chunk))
            return OK
        f = frames.carve(chunks(64), strict=not getattr(a, "loose", False), start=a.start, stop=a.stop, space=space, most=getattr(a, "most", None))
        if a.command == "boundaries":
            show(channels.boundaries(f.select(F.col("offset").alias("start"), "ts"), a.date).orderBy("label"))
        elif a.channels:
            show(channels.channel_stats(f.withColumn("size", F.octet_length("payload").cast("bigint"))).orderBy("channel"))
        else:
            show(f.drop("payload").orderBy("offset"))
    elif a.command == "layout":
        of, times, _, _ = framing(a.framing)
        found = layout.hypotheses(layout.evidence(chunks(max(of.longest, of.run)), of, a.size, times, start=a.start), a.top)
        best = layout.best(found).withColumn("notes", layout.notes())
        show(found.orderBy("fragment_size", "rank"))
        show(best)
        first = best.first()
        return OK if first is not None and first["confidence"] >= 0.5 else REVIEW
    elif a.command == "recover":
        of, times, begins, media = framing(a.framing)
        pieces = rebuild.Fragments(space, a.fragment, a.data_offset)
        starts = rebuild.recording_starts(rebuild.heads(spark, pieces, of.longest), of.sync + bytes([begins]), times[begins], a.date, a.fragment, a.data_offset)
        done = rebuild.recover_files(spark, starts.select(F.hash("label").cast("bigint").alias("problem"), F.explode("starts").alias("start")), pieces, of, media, a.out, a.label)
        show(done.orderBy("start"))
        return OK if not done.where("status <> 'UNKNOWN'").count() else REVIEW
    elif a.command == "map":
        blocks = reports.mapfile(spark, a.mapfile)
        expected = blocks.select("source").distinct().withColumns({"expected_start": F.lit(0 if a.size is not None else None).cast("bigint"), "expected_size": F.lit(a.size).cast("bigint")})
        row = intervals.coverage(blocks, expected)
        show(row)
        return OK if (r := row.first()) is not None and r["complete"] else REVIEW
    elif a.command == "verify-audit":
        row = integrity.verify_chain(reports.audit_log(spark, a.log))
        show(row)
        return FAILED if row.where("bad > 0").count() else OK
    elif a.command == "validate":
        with open(a.manifest) as f:
            out = corpus.run(spark, json.load(f), a.root)
        show(out)
        return REVIEW if out.where("status <> 'PASS'").count() else OK
    return OK


if __name__ == "__main__":
    sys.exit(main())
