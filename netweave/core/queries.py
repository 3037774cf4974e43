"""The queries of the general problems, on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netweave.core import compaction, drift, nested, orphans, profile
from netweave.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = compaction.compact_sink_files(table(spark, sf_dir, "sink_files"))
    return compaction.folded_lines(spark, root)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounds = nested.flatten_tied(table(spark, sf_dir, "certificate_sweep"))["round"]
    return rounds.where("face_pos is not null").select("record_id", "face_pos", "round_pos", "phase")


def p2_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = nested.flatten_tied(table(spark, sf_dir, "certificate_sweep"))["face"]
    return faces.where("face_pos is not null").select("record_id", "face_pos", "phase", "n_tied", "walk_live", "walk_pivots", "walk_rounds", "ladder_rung", "ladder_status", "n_rounds")


def p2_rungs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.flatten_tied(table(spark, sf_dir, "certificate_sweep"))["rung"].select("record_id", "face_pos", "rung_pos", "rung", "phase", "status")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.changes(table(spark, sf_dir, "sink_files"))


def p3_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.type_files(table(spark, sf_dir, "sink_files"))


def p3_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.union_table(table(spark, sf_dir, "sink_files"))


def p3_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.column_summary(drift.union_table(table(spark, sf_dir, "sink_files")))


def _p4_tables(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [table(spark, sf_dir, t) for t in ("certificate_sweep", "flows_manifest", "flow_directories")]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphans(*_p4_tables(spark, sf_dir))


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphan_counts(*_p4_tables(spark, sf_dir))


#: What the profile expects of a column, beside its type.
RULES = {
    "network": profile.Rule(pattern=r"[A-Z][a-z]+(?:-[A-Z][a-z]+)*"),
    "gate_revision": profile.Rule(pattern=r"gate_r\d+"),
    "residual": profile.Rule(0.0, 1.0),
    "support_changes_final": profile.Rule(0.0, 1e6),
    "seconds": profile.Rule(0.0, 864000.0),
    "conservation_max": profile.Rule(0.0, 1e-6),
}


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.found(spark, f"{sf_dir}/corpus_sweep.parquet")


def p5_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profile(spark, f"{sf_dir}/corpus_sweep.parquet", RULES).drop("n_scanned", "n_chunks")


QUERIES = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_faces": p2_faces,
    "p2_rungs": p2_rungs,
    "p3_found": p3_found,
    "p3_types": p3_types,
    "p3_union": p3_union,
    "p3_columns": p3_columns,
    "p4_found": p4_found,
    "p4_counts": p4_counts,
    "p5_found": p5_found,
    "p5_profile": p5_profile,
}

_LINES_SQL = """
lines as (select sink, file_id, written_at, i as line_no, trim(ltrim(string_split(coalesce(body, ''), chr(10))[i], chr(65279)), ' ' || chr(9) || chr(13)) as line
          from sink_files, unnest(range(1, len(string_split(coalesce(body, ''), chr(10))) + 1)) u(i)),
records as (select sink, file_id, written_at, line_no, line from lines where line like '{%' and json_valid(line))"""

#: The names in the given tables that mean one quantity; the operator finds them by their words, the SQL is told.
_RENAMED = [
    ["budget_s", "budget_seconds", "budgetSeconds"], ["peak_rss", "peak_rss_mb"], ["windows_held", "env_windows_held", "envelope_windows_held"], ["unresolved", "is_unresolved", "unresolved_flag"],
    ["inclusion_envelope_settled", "envelope_settled", "inclusionEnvelopeSettled"],
]

_P4_SQL = r"""
with d as (select regexp_replace(regexp_replace(regexp_replace(translate(lower(trim(directory)), '', '/'), '/+', '/', 'g'), '^(\./)+', ''), '^/|/$', '', 'g') k, opened_at s, coalesce(closed_at, timestamp '9999-12-31') e from flow_directories),
m as (select lower(regexp_replace(trim(flow_file), '^.*[/\\]', '')) k, regexp_extract(lower(trim(flow_sha256)), '^(?:sha-?256[:=])?\s*([0-9a-f]{16})', 1) g, listed_at s, coalesce(removed_at, timestamp '9999-12-31') e from flows_manifest),
c as (select record_id, lower(regexp_replace(trim(flow_file), '^.*[/\\]', '')) k, regexp_extract(lower(trim(flow_sha256)), '^(?:sha-?256[:=])?\s*([0-9a-f]{16})', 1) g, recorded_at t from certificate_sweep where flow_file is not null),
f as (select c.record_id, c.t, c.g, count(m.k) n, coalesce(bool_or(m.s <= c.t and m.e > c.t), false) good, coalesce(bool_or(m.s <= c.t), false) had,
        coalesce(bool_or(m.s <= c.t and m.e > c.t and m.g = c.g), false) right_digest, coalesce(bool_or(m.g = c.g), false) some_digest
      from c left join m on c.k = m.k group by all),
p as (select a.entry_id, a.listed_at t, count(d.k) n, coalesce(bool_or(d.s <= a.listed_at and d.e > a.listed_at), false) good, coalesce(bool_or(d.s <= a.listed_at), false) had
      from flows_manifest a left join d on regexp_replace(regexp_replace(regexp_replace(translate(lower(trim(a.directory)), '', '/'), '/+', '/', 'g'), '^(\./)+', ''), '^/|/$', '', 'g') = d.k
      where a.directory is not null group by all),
found as (
  select 'certificate_sweep' src_table, record_id row_id, 'flow_file' field, case when n = 0 then 'missing' when had then 'deleted' else 'late' end status, t from f where not good
  union all select 'certificate_sweep', record_id, 'flow_sha256', case when some_digest then 'deleted' else 'missing' end, t from f where good and g is not null and not right_digest
  union all select 'flows_manifest', entry_id, 'directory', case when n = 0 then 'missing' when had then 'deleted' else 'late' end, t from p where not good)
"""


def _items_sql(x: str) -> str:
    """The items of a JSON list, a lone object or a text that holds either, as a list of JSON values."""
    held = f"(case json_type({x}) when 'VARCHAR' then try_cast({x}->>'$' as json) else {x} end)"
    return f"(case json_type({held}) when 'ARRAY' then json_extract({held}, '$[*]') when 'OBJECT' then [{held}] else [] end)"


#: The faces of ``tied`` with their rounds, as far as queries of other modules need them too.
TIED_SQL = f"""
t0 as (select record_id, try_cast(trim(ltrim(tied, chr(65279)), ' ' || chr(9) || chr(10) || chr(13)) as json) j from certificate_sweep),
t1 as (select record_id, case when json_type(j) = 'VARCHAR' then try_cast(j->>'$' as json) else j end j from t0),
t2 as (select record_id, j from t1 where json_type(j) = 'OBJECT'),
faces as (select record_id, 0 face_pos, j face from t2 union all
  select record_id, face_pos, face from (select record_id, generate_subscripts(l, 1)::int face_pos, unnest(l) face from (select record_id, {_items_sql("(j->'reopened')")} l from t2)) where json_type(face) = 'OBJECT'),
facer as (select record_id, face_pos, face, {_items_sql("(face->'rounds')")} rl from faces),
rounds as (select record_id, face_pos, round_pos, r from (select record_id, face_pos, generate_subscripts(rl, 1)::int - 1 round_pos, unnest(rl) r from facer) where json_type(r) = 'OBJECT')"""

#: Columns of corpus_sweep by kind.
_REAL = ["mu", "residual", "conservation_max", "support_changes_final", "budget_seconds", "seconds", "peak_rss_mb"]
_WHOLE = ["record_id", "load_id", "sweep_id", "n_nodes", "n_zones", "n_links", "cores", "iterations", "resumed_from", "converged", "unresolved", "support_measured"]
_WORDS = ["exhibit", "network", "gate_revision", "stopped_on", "polish_method", "origin"]
_TIMES = ["recorded_at", "ingested_at"]


def _column_sql(c: str) -> str:
    rule = RULES.get(c)
    broken = "false" if rule is None else f"not regexp_full_match({c}, '{rule.pattern}')" if rule.pattern else f"{c} < {rule.low} or {c} > {rule.high} or isnan({c})"
    nan = f"count_if(isnan({c}))" if c in _REAL else "0"
    number = f"min({c}) filter (not isnan({c}))::double, max({c}) filter (not isnan({c}))::double" if c in _REAL else f"min({c})::double, max({c})::double" if c in _WHOLE else "null::double, null::double"
    text = f"min({c}), max({c})" if c in _WORDS else f"strftime(min({c}), '%Y-%m-%d %H:%M:%S'), strftime(max({c}), '%Y-%m-%d %H:%M:%S')" if c in _TIMES else "null, null"
    return f"select '{c}', count(*), count(*) - count({c}), {nan}, count_if({broken}), {number}, {text}, count(distinct {c}) from corpus_sweep"


SQL = {
    "p2_found": f"with {TIED_SQL} select record_id, face_pos, round_pos, coalesce(r->>'phase', '') as phase from rounds",
    "p2_faces": f"""with {TIED_SQL} select record_id, face_pos, coalesce(face->>'phase', '') as phase, (face->>'n_tied')::bigint n_tied, (face->>'$.walk.live_initial')::bigint walk_live, (face->>'$.walk.pivots')::bigint walk_pivots,
(face->>'$.walk.rounds')::bigint walk_rounds, coalesce(face->>'$.ladder.rung', '') ladder_rung, coalesce(face->>'$.ladder.status', '') ladder_status, len(rl)::int n_rounds from facer""",
    "p2_rungs": f"""with {TIED_SQL}, l as (select record_id, face_pos, {_items_sql("(face->'$.ladder.trail')")} l from faces), e as (select record_id, face_pos, generate_subscripts(l, 1)::int - 1 rung_pos, unnest(l) r from l)
select record_id, face_pos, rung_pos, coalesce(r->>'rung', '') rung, coalesce(r->>'phase', '') as phase, coalesce(r->>'status', '') status from e where json_type(r) = 'OBJECT'""",
    "p5_profile": "select * from (" + " union all ".join(map(_column_sql, _REAL + _WHOLE + _WORDS + _TIMES)) + ") t(column_name, n_rows, n_null, n_nan, n_violations, lo, hi, lo_text, hi_text, n_distinct)",
    "p3_columns": f"""with {_LINES_SQL},
k as (select file_id, line_no, line, unnest(json_keys(line)) field from records),
g(field, grp) as (values {", ".join(f"('{f}', {i})" for i, fields in enumerate(_RENAMED) for f in fields)}),
t as (select file_id, line_no, k.field, coalesce('g' || grp, k.field) grp, line->>('$."' || k.field || '"') v, json_type(line, '$."' || k.field || '"') jt from k left join g using (field)),
q as (select grp, arg_max(field, (length(field), field)) quantity, list_distinct(list(case jt when 'BOOLEAN' then 'boolean' when 'VARCHAR' then 'string' when 'OBJECT' then 'object' when 'ARRAY' then 'array' else 'number' end) filter (jt <> 'NULL')) kinds from t group by 1),
ty as (select grp, quantity, case when coalesce(len(kinds), 0) = 0 then 'string' when len(kinds) = 1 then case kinds[1] when 'number' then 'double' when 'boolean' then 'boolean' else 'string' end
  when list_contains(kinds, 'object') or list_contains(kinds, 'array') or list_contains(kinds, 'string') then 'string' else 'double' end data_type from q),
r as (select grp, file_id, line_no, arg_min(v, field) filter (v is not null) v from t group by all),
c as (select quantity, data_type, case data_type when 'double' then try_cast(v as double)::varchar when 'boolean' then try_cast(v as boolean)::varchar else v end v from r join ty using (grp))
select quantity, data_type, count(v) n_values, case when data_type = 'double' then sum(round(try_cast(v as double), 3)::decimal(28,3)) filter (data_type = 'double')::double end total, case when data_type = 'boolean' then count_if(v = 'true') end n_true from c group by quantity, data_type""",
    "p3_types": f"""with {_LINES_SQL},
k as (select file_id, line, unnest(json_keys(line)) field from records),
t as (select file_id, field, case json_type(line, '$."' || field || '"') when 'NULL' then 'null' when 'BOOLEAN' then 'boolean' when 'VARCHAR' then 'string' when 'OBJECT' then 'object' when 'ARRAY' then 'array' else 'number' end json_type from k),
d as (select distinct * from t)
select field, json_type, count(*) n_files from d a where json_type <> 'null' or not exists (select 1 from d b where b.file_id = a.file_id and b.field = a.field and b.json_type <> 'null') group by all""",
    "p4_found": _P4_SQL + "select src_table, row_id, field, status from found",
    "p4_counts": _P4_SQL + "select src_table, field, status, strftime(t, '%Y-%m') as month, count(*) as n_orphans from found group by all",
}
