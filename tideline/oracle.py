"""SQL that says what a query gives, for DuckDB over the same tables."""

HELD = """held as (
    select label, epoch(timestamp)::bigint as t, any_value(collection) as collection,
           max_by(struct_pack(v := case when value is null or isnan(value) then null else value end), pubtime) as s
    from series_reading where timestamp is not null and label is not null group by 1, 2),
valued as (
    select h.label, h.t, h.s.v as v, i.period_s, i.low, i.high, h.t // i.period_s as k
    from held h join collection_info i using (collection) where h.s.v is not null)"""

P1_FOUND = """with listed as (select distinct label, digest from commit_row where label is not null and digest is not null),
n as (select digest, count(distinct timestamp) as n from stored_row group by 1),
files as (select label, count(*) as n_files from listed group by 1)
select l.label, l.digest from listed l left join n using (digest) join files f on f.label = l.label
where coalesce(n.n, 0) < 64 and f.n_files > 1"""

P1_COMPACTED = """with listed as (select distinct label, digest from commit_row where label is not null and digest is not null),
n as (select digest, count(distinct timestamp) as n from stored_row group by 1),
files as (select label, count(*) as n_files from listed group by 1)
select l.label, count(*)::bigint as files_before, coalesce(sum(n.n), 0)::bigint as n_records
from listed l left join n using (digest) join files f on f.label = l.label
where coalesce(n.n, 0) < 64 and f.n_files > 1 group by 1"""

P1_MERGED = """with listed as (select distinct label, digest from commit_row where label is not null and digest is not null),
held as (select digest, timestamp, max(value) filter (not isnan(value)) as v, bool_or(isnan(value)) as has_nan from stored_row where digest is not null and timestamp is not null group by 1, 2),
n as (select digest, count(*) as n from held group by 1),
files as (select label, count(*) as n_files from listed group by 1),
merged as (select l.label, l.digest from listed l left join n using (digest) join files f on f.label = l.label where coalesce(n.n, 0) < 64 and f.n_files > 1),
records as (select m.label, m.digest, h.timestamp, case when h.has_nan then 'nan'::double else h.v end as value from merged m join held h using (digest))"""
P1_MANIFEST = P1_MERGED + " select label, min(timestamp) as start, max(timestamp) as stop, count(*)::bigint as length from records group by 1"
P1_RECORDS = P1_MERGED + " select label, digest, timestamp, value from records"

P2_BASE = """with r as (
    select snapshot_no::bigint as snapshot_no, lower(trim(label)) as label, start, stop,
           nullif(regexp_extract(lower(digest), '[0-9a-f]{40}'), '') as digest, delivered_at from commit_snapshot),
d as (select snapshot_no, label, start, max_by(struct_pack(stop := stop, digest := digest), delivered_at) as s from r group by 1, 2, 3),
nos as (select snapshot_no, lag(snapshot_no) over (order by snapshot_no) as prev from (select distinct snapshot_no from d)),
pairs as (
    select coalesce(a.snapshot_no, n2.snapshot_no) as snapshot_no, coalesce(a.label, b.label) as label, coalesce(a.start, b.start) as start, a.s as new, b.s as old, a.label is not null as has_new, b.label is not null as has_old
    from (select d.*, n.prev from d join nos n using (snapshot_no) where n.prev is not null) a
    full outer join (select d.label, d.start, d.s, n.snapshot_no from d join nos n on n.prev = d.snapshot_no) b
      on a.snapshot_no = b.snapshot_no and a.label = b.label and a.start = b.start
    left join nos n2 on n2.snapshot_no = b.snapshot_no),
c as (
    select *, case when not has_old then 'added' when not has_new then 'removed' else 'changed' end as change_kind from pairs
    where not has_old or not has_new or new.stop is distinct from old.stop or new.digest is distinct from old.digest)"""

P2_FOUND = P2_BASE + " select snapshot_no, label, start, change_kind from c"
P2_CHANGES = P2_BASE + " select snapshot_no, label, start, change_kind, old.stop as old_stop, old.digest as old_digest, new.stop as new_stop, new.digest as new_digest from c"

P3_FOUND = f"""with {HELD},
g as (select label, period_s, unnest(generate_series(min(k), max(k))) as k from valued group by 1, 2)
select g.label, (g.k * g.period_s)::bigint as period_start from g
where not exists (select 1 from valued v where v.label = g.label and v.k = g.k)"""

P3_OBSERVED = f"""with {HELD},
c as (select label, k, count(*)::int as n, round(avg(v) filter (where not isinf(v)), 6) as observed from valued group by 1, 2),
g as (select label, period_s, unnest(generate_series(min(k), max(k))) as k from valued group by 1, 2)
select g.label, (g.k * g.period_s)::bigint as period_start, c.observed, coalesce(c.n, 0) as n_readings, c.n is null as missing
from g left join c on c.label = g.label and c.k = g.k"""

P5_LIMITS_AND_RUNS = f"""with {HELD},
e as (select label, t, v, low, high, v is not distinct from lag(v) over w as same, lag(v) over w is not null as paired from valued window w as (partition by label order by t)),
r as (select *, sum(case when same then 0 else 1 end) over (partition by label order by t) as run from e),
s as (select *, count(*) over (partition by label, run) as size, 2 * sum(same::int) over (partition by label) > sum(paired::int) over (partition by label) as steady from r)
select label, t as epoch_s, case when v < low or v > high or isinf(v) then 'impossible' else 'stuck' end as kind
from s where v < low or v > high or isinf(v) or (size >= 8 and not steady)"""

P4_BASE = r"""with rows_ as (
    select file_no, line_no, any_value(label) as label, max(regexp_replace(regexp_replace(line, '\r+$', ''), '^\x{FEFF}', '')) as line from csv_input group by 1, 2),
heads as (select file_no, list_transform(string_split(line, ','), lambda x: lower(trim(replace(x, '"', '')))) as names from rows_ where line_no = 1),
l as (
    select r.file_no, r.line_no, r.label, r.line, h.names,
           regexp_full_match(r.line, '([^",]*|"([^"]|"")*")(,([^",]*|"([^"]|"")*"))*') as good,
           regexp_extract_all(r.line || ',', '("([^"]|"")*"|[^",]*),', 1) as cells
    from rows_ r left join heads h using (file_no) where r.line_no > 1),
c as (
    select *, case
        when not coalesce(good, true) then 'quoting'
        when line is null or trim(line) = '' or len(cells) <> len(names) then 'columns'
        when not regexp_full_match(trim(replace(cells[list_position(names, 'timestamp')], '"', '')), '\d{4}-\d{2}-\d{2}([T ]([01]\d|2[0-3]):[0-5]\d(:[0-5]\d)?)?')
             or try_cast(substr(trim(replace(cells[list_position(names, 'timestamp')], '"', '')), 1, 10) as date) is null then 'timestamp'
        when lower(trim(replace(cells[list_position(names, 'value')], '"', ''))) <> 'nan'
             and not regexp_full_match(trim(replace(cells[list_position(names, 'value')], '"', '')), '[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?') then 'value'
        end as reason from l)"""
P4_FOUND = P4_BASE + " select file_no, line_no::bigint as line_no, reason from c where reason is not null"

_CELL = """case when list_position(names, '{0}') is null then null when starts_with(cells[list_position(names, '{0}')], '"')
    then replace(substr(cells[list_position(names, '{0}')], 2, length(cells[list_position(names, '{0}')]) - 2), '""', '"') else cells[list_position(names, '{0}')] end"""
P4_LOADED = (
    P4_BASE
    + f" select file_no, line_no::bigint as line_no, label, cast(replace(trim({_CELL.format('timestamp')}), 'T', ' ') as timestamp) as timestamp, cast(trim({_CELL.format('value')}) as double) as value,"
    + f" {_CELL.format('category')} as category, {_CELL.format('note')} as note from c where reason is null"
)


def sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND, "p1_compacted": P1_COMPACTED, "p1_manifest": P1_MANIFEST, "p1_records": P1_RECORDS, "p2_found": P2_FOUND, "p2_changes": P2_CHANGES, "p3_found": P3_FOUND, "p3_observed": P3_OBSERVED, "p4_loaded": P4_LOADED, "p5_limits_and_runs": P5_LIMITS_AND_RUNS, "p4_found": P4_FOUND}
