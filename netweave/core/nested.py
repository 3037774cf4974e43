"""Deeply nested records: one pass that emits tagged rows of flat tables with parent-child links.

A depth-first visitor walks each ``tied`` value once and emits rows ``(tag, record_id, key, parent_key,
payload)``. They are written once, partitioned by tag; each flat table is then its tag's folder with
its own schema applied to the payload. Tags and keys:

face        ``<record_id>/<face_pos>``; parent is the record. A face that a reopened face opened again has the
            position ``<place>.<place>``, so that its key names the whole way, and ``opened_by`` names the face before
round       ``<record_id>/<face_pos>/<round_pos>``; parent is the face
rung        ``<record_id>/<face_pos>/r<rung_pos>``: the entries of ``ladder.trail``; parent is the face
weight      entries of ``weights`` (destination, link, weight) and ``base_weight`` (destination, weight); parent is the face

Edge cases: null, blank, cut-off or non-object texts give no row; the literals NaN, Infinity and -Infinity are
numbers, and come out null; an object wrapped as JSON text inside a string is unwrapped however often, likewise
``rounds``, ``reopened`` and ``trail``; a lone object stands for a list of one; entries that aren't objects keep their
place but give no row; a missing or null phase is ''; other fields of the wrong type come out null; a null record_id
shows as "None" in keys; face_pos is null for faces opened again at second hand, since it counts those of the record
itself; an empty table gives empty tables.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netweave.functions.jsontext import parse
from netweave.session import map_rows, work_dir

_TAGGED = "record_id long, key string, parent_key string, payload string, tag string"
SCHEMAS = {
    "face": "face_pos int, depth int, opened_by string, phase string, n_contested long, n_tied long, pairs long, verdict string, walk_live long, walk_pivots long, walk_rounds long, ladder_rung string, ladder_status string, n_rounds int",
    "round": "face_pos int, round_pos int, phase string, outer long, round long, n_tied long, converged boolean, residual double, retired long, retired_dest long, retired_link long",
    "rung": "face_pos int, rung_pos int, rung string, phase string, status string",
    "weight": "face_pos int, kind string, dest long, link long, weight double",
}


def _unwrapped(value):
    """The value inside a text that is itself JSON, else the value; every step leaves a shorter text."""
    while isinstance(value, str):
        value = parse(value, constants=True)
    return value


def _object(value) -> dict:
    return value if isinstance(value, dict) else {}


def _items(value) -> list:
    value = _unwrapped(value)
    return value if isinstance(value, list) else [value] if isinstance(value, dict) else []


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value)


def _whole(value):
    return value if isinstance(value, int) and not isinstance(value, bool) and abs(value) < 1 << 63 else None


def _real(value):
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) and -_MOST <= value <= _MOST else None


_MOST = sys.float_info.max


def _face(record_id: int, key: str, pos: int | None, depth: int, opened_by: str | None, face: dict) -> Iterator[tuple]:
    """The rows of one face without those it opened again: itself, its rounds, rungs and weights."""
    rounds, walk, ladder = _items(face.get("rounds")), _object(face.get("walk")), _object(face.get("ladder"))
    yield record_id, key, str(record_id), json.dumps({
        "face_pos": pos, "depth": depth, "opened_by": opened_by, "phase": _text(face.get("phase")), "n_contested": _whole(face.get("n_contested")), "n_tied": _whole(face.get("n_tied")),
        "pairs": _whole(face.get("pairs")), "verdict": _text(face.get("verdict")), "walk_live": _whole(walk.get("live_initial")), "walk_pivots": _whole(walk.get("pivots")),
        "walk_rounds": _whole(walk.get("rounds")), "ladder_rung": _text(ladder.get("rung")), "ladder_status": _text(ladder.get("status")), "n_rounds": len(rounds)}), "face"
    for at, r in enumerate(rounds):
        if isinstance(r, dict):
            pair = r["retired_pair"] if isinstance(r.get("retired_pair"), list) else []
            yield record_id, f"{key}/{at}", key, json.dumps({
                "face_pos": pos, "round_pos": at, "phase": _text(r.get("phase")), "outer": _whole(r.get("outer")), "round": _whole(r.get("round")),
                "n_tied": _whole(r.get("n_tied")), "converged": r["converged"] if isinstance(r.get("converged"), bool) else None,
                "residual": _real(r.get("residual")), "retired": _whole(r.get("retired")),
                "retired_dest": _whole(pair[0]) if len(pair) == 2 else None, "retired_link": _whole(pair[1]) if len(pair) == 2 else None}), "round"
    for at, r in enumerate(_items(ladder.get("trail"))):
        if isinstance(r, dict):
            yield record_id, f"{key}/r{at}", key, json.dumps({"face_pos": pos, "rung_pos": at, **{n: _text(r.get(n)) for n in ("rung", "phase", "status")}}), "rung"
    listed = face["weights"] if isinstance(face.get("weights"), list) else []
    found = [("tied", *map(_whole, w[:2]), _real(w[2])) for w in listed if isinstance(w, list) and len(w) == 3]
    found += [("base", int(d), None, _real(w)) for d, w in _object(face.get("base_weight")).items() if d.isdecimal() and len(d) < 19]
    for at, (kind, dest, link, weight) in enumerate(found):
        yield record_id, f"{key}/w{at}", key, json.dumps({"face_pos": pos, "kind": kind, "dest": dest, "link": link, "weight": weight}), "weight"


def visit(record_id: int, text: str | None) -> Iterator[tuple]:
    """Tagged rows of one record, depth first: each face with all of its own, then the faces it opened again."""
    tied = _unwrapped(text)
    if not isinstance(tied, dict):
        return
    # faces still to visit, the next one last: key, position, depth, the face that opened it, value
    stack = [(f"{record_id}/0", 0, 0, None, tied)]
    while stack:
        key, pos, depth, opened_by, face = stack.pop()
        yield from _face(record_id, key, pos, depth, opened_by, face)
        for at, again in reversed(list(enumerate(_items(face.get("reopened")), 1))):
            if isinstance(again, dict):
                stack.append((f"{record_id}/{at}" if depth == 0 else f"{key}.{at}", at if depth == 0 else None, depth + 1, key, again))


def _emit(ids: list, texts: list) -> Iterator[tuple]:
    for i, text in zip(ids, texts):
        yield from visit(i, text)


def flatten_tied(records: DataFrame, root: str | None = None) -> dict[str, DataFrame]:
    """The flat tables of ``tied``: record_id, key, parent_key and the fields of each tag.

    The records are read and parsed once; no shuffle takes place.
    """
    spark, root = records.sparkSession, root or work_dir(records.sparkSession, "nested")
    map_rows(records.select("record_id", "tied"), _emit, _TAGGED).write.partitionBy("tag").parquet(root)
    return {tag: tagged_table(spark, root, tag) for tag in SCHEMAS}


def tagged_table(spark: SparkSession, root: str, tag: str) -> DataFrame:
    rows = spark.read.schema(_TAGGED).parquet(root).where(F.col("tag") == tag)
    return rows.select("record_id", "key", "parent_key", F.from_json("payload", SCHEMAS[tag]).alias("p")).select("record_id", "key", "parent_key", "p.*")
