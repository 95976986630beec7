"""Repositories, collections and series: versioned range overwrite on immutable Parquet tables.

Data lies in ``data/<digest>``, one folder of Parquet files per write, whether of one series or of many, named by a checksum of its rows, so that the same rows are stored once. A
collection's changelog says which intervals of which tables are visible. Readers prune tables on the driver, then read all that are left in
one scan; windows and bounds become predicates on the index columns, which the scan pushes down.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.operators.frame import Frame, Pages, kv_upsert, tail, united, update_columns
from tideline.store.bounds import Closed, Interval, by_start, ends_after
from tideline.store.changelog import ROOT, Changelog, Revision, hextime
from tideline.store.files import Files
from tideline.store.manifest import Manifest, Segment
from tideline.store.schema import HIGHEST, LOWEST, Schema, SchemaColumn

PAGE = 500_000
#: Column that tells the series of a table with several apart.
PART = "_label"
#: Segments, each two short texts, up to which their list is broadcast.
BROADCAST_ROWS = 100_000
#: Seconds that unreferenced data and old revisions are kept.
TIMEOUT = 600


class Series:
    """One label of a collection: a table sorted by its index."""

    def __init__(self, collection: Collection, label: str):
        self.collection, self.label = collection, label
        self.schema, self.repo = collection.schema, collection.repo

    # --- reading

    def segments(self, start: Any = None, stop: Any = None, before: Any = None, closed: Any = "l") -> list[Segment]:
        return self.collection.manifest(before).visible(self.label, Interval.of(self.schema, start, stop, closed))

    def df(self, start: Any = None, stop: Any = None, before: Any = None, closed: Any = "l", limit: int | None = None, offset: int | None = None, select: str | list[str] | None = None) -> DataFrame:
        """Rows in [start, stop) (see ``closed``) as they were before a time. With limit or offset they come in the order of the index."""
        out = self.collection.scan(self.segments(start, stop, before, closed))
        if limit is not None or offset:
            out = out.orderBy(*self.schema.idx).offset(offset or 0)
            out = out.limit(limit) if limit is not None else out
        return chosen(out, select)

    def frame(self, *args: Any, **kw: Any) -> Frame:
        df = self.df(*args, **kw)
        return Frame(df, Schema(kind=self.schema.kind, **{n: c for n, c in self.schema.columns.items() if n in df.columns}) if set(df.columns) & set(self.schema.idx) else None)

    def tail(self, length: int = 1, start: Any = None, stop: Any = None, before: Any = None, closed: Any = "l", limit: int | None = None, offset: int | None = None, select: Any = None) -> DataFrame:
        """The last rows of a range; limit and offset count within them."""
        return chosen(tail(self.df(start, stop, before, closed), self.schema.idx, length, limit, offset), select)

    def paginate(self, step: int = PAGE, start: Any = None, stop: Any = None, before: Any = None, closed: Any = "l", limit: int | None = None, offset: int | None = None, select: Any = None) -> Pages:
        """Pages of at most ``step`` rows in the order of the index, none of them empty; rows with equal index values are not lost between pages."""
        return Pages(self.df(start, stop, before, closed, limit, offset), self.schema.idx, step, lambda rows: chosen(rows, select))

    def __len__(self) -> int:
        """Tables that are shown whole are counted by the manifest, the others by a scan."""
        segments = self.segments()
        cut = [s for s in segments if not s.whole]
        return sum(s.length for s in segments if s.whole) + (self.collection.scan(cut).count() if cut else 0)

    def __bool__(self) -> bool:
        return self.label in self.collection.manifest().labels

    # --- writing

    def write(self, data: Any, start: Any = None, stop: Any = None, closed: Any = "b", root: bool = False, presorted: bool = False) -> list[Revision]:
        """Replaces everything between start and stop, by default the data's first and last index, by the data.

        Rows outside of that interval are not shown. ``root`` starts a new branch. Inside multi() the write waits for the block's end. Nothing happens for no data without bounds, nor if the
        newest revision says the same.
        """
        df = complete(self.schema, self.schema.create(self.repo.spark, data))
        if self.schema.kind == "kv" and start is None and stop is None and not root:
            return self._upsert(df)
        if self.collection._batch is not None and not root:
            self.collection._batch.append(Pending(self, df, start, stop, closed))
            return []
        new = self._segment(df, start, stop, closed, presorted)
        return self.collection.put([new], root) if new else []

    def _segment(self, df: DataFrame, start: Any, stop: Any, closed: Any, presorted: bool) -> Segment | None:
        return self._shown(self.repo.store(self.schema, df, presorted), start, stop, closed)

    def _shown(self, stored: Stored, start: Any, stop: Any, closed: Any, part: str | None = None) -> Segment | None:
        """The segment of rows that have been stored; none for no rows without both bounds."""
        if not stored.length and (start is None or stop is None):
            return None
        n = len(self.schema.idx)
        given = Interval.of(self.schema, start, stop, closed)
        first = given.start if start is not None else stored.first if stored.length else (LOWEST,) * n
        last = given.stop if stop is not None else stored.last if stored.length else (HIGHEST,) * n
        if first != last and Interval(first, last).empty:
            raise ValueError(f"start {first} lies after stop {last}")
        interval = Interval(first, last, Closed.cast(closed))
        whole = bool(stored.length) and interval.covers(Interval(stored.first, stored.last))
        return Segment(self.label, interval, stored.digest, stored.length, whole, part)

    def _upsert(self, new: DataFrame) -> list[Revision]:
        def written(held: Manifest) -> Segment | None:
            span = self._span(new)
            if span is None:
                return None
            stored = self.repo.store(self.schema, kv_upsert(self.collection.scan(held.visible(self.label, span)), new, self.schema.idx))
            return Segment(self.label, span, stored.digest, stored.length)

        return self.collection.put([written])

    def _span(self, df: DataFrame) -> Interval | None:
        """From the first to the last index of some rows."""
        edges = df.agg(F.min(F.struct(*self.schema.idx)).alias("a"), F.max(F.struct(*self.schema.idx)).alias("b")).first()
        return None if edges.a is None else Interval(tuple(edges.a), tuple(edges.b))

    def delete(self, *keys: Any, start: Any = None, stop: Any = None, closed: Any = "b", root: bool = False) -> list[Revision]:
        """Removes a range, or rows by key: delete(start=a, stop=b), delete(key, ...). A key is an index value or tuple of them."""
        if keys:
            gone = [Segment(self.label, Interval.of(self.schema, k, k, "b"), "", 0) for k in keys]
            return self.collection.put(gone, root)
        return self.collection.put([Segment(self.label, Interval.of(self.schema, start, stop, closed), "", 0)], root)

    def update(self, data: Any) -> list[Revision]:
        """Changes some columns where index values are stored already, and adds rows before and after those with zero values for the other columns; ValueError if index values differ in between."""
        df = self.schema.create(self.repo.spark, data)
        missing = set(self.schema.idx) - set(df.columns)
        if missing:
            raise ValueError(f"index columns are missing: {sorted(missing)}")

        def written(held: Manifest) -> Segment | None:
            span = self._span(df)
            if span is None:
                return None
            stored = self.repo.store(self.schema, update_columns(self.collection.scan(held.visible(self.label, span)), df, self.schema))
            return Segment(self.label, span, stored.digest, stored.length)

        return self.collection.put([written])


class Collection:
    """Series that share a schema and a changelog."""

    def __init__(self, repo: Repo, label: str, schema: Schema, path: str):
        self.repo, self.label, self.schema, self.path = repo, label, schema, path
        self.changelog = Changelog(repo.files, f"collections/{path}/_log")
        self._batch: list[Segment | Pending | Callable[[Manifest], Segment | None]] | None = None

    def series(self, label: str) -> Series:
        label = label.strip()
        if not label:
            raise ValueError("a series needs a label")
        return Series(self, label)

    __truediv__ = series

    def ls(self) -> list[str]:
        return self.manifest().labels

    def __iter__(self) -> Iterator[Series]:
        return (self.series(x) for x in self.ls())

    def __contains__(self, label: str) -> bool:
        return label in self.ls()

    def refresh(self) -> None:
        self.changelog.refresh()

    def manifest(self, before: Any = None, revision: Revision | None = None) -> Manifest:
        revision = revision or self.changelog.leaf(before)
        return Manifest.loads(self.schema, self.changelog.read(revision) if revision else None)

    def df(self, before: Any = None) -> DataFrame:
        """All series with their label in one DataFrame."""
        return self.scan(self.manifest(before).segments, label=True)

    def scan(self, segments: list[Segment] | tuple[Segment, ...], label: bool = False) -> DataFrame:
        """The rows that segments show, from one scan for each way of naming columns."""
        spark, name = self.repo.spark, "_label"
        groups: dict[tuple, list[Segment]] = {}
        for s in segments:
            groups.setdefault((s.columns, s.fill), []).append(s)
        parts = []
        for (columns, fill), some in groups.items():
            stored = dict(columns) if columns is not None else {n: n for n in self.schema}
            shared = any(s.part is not None for s in some)
            fields = [T.StructField(stored[n], c.spark) for n, c in self.schema.columns.items() if n in stored]
            fields += [T.StructField(PART, T.StringType())] if shared else []
            df = spark.read.schema(T.StructType(fields)).parquet(*self.repo.data_uris(dict.fromkeys(s.digest for s in some)))
            values = {n: F.col(f"`{stored[n]}`").alias(n) for n in stored} | {n: self.schema[n].literal(self.schema[n].from_json(json.loads(v))).alias(n) for n, v in fill}
            of_part = [F.coalesce(F.col(PART), F.lit("")).alias("_part")] if shared else [F.lit("").alias("_part")]
            if shared and not label:
                wanted = F.col(PART).isin(sorted({s.part for s in some if s.part is not None}))
                df = df.where(wanted if all(s.part is not None for s in some) else wanted | F.col(PART).isNull())
            need_digest = label or shared or any(not s.whole for s in some)
            if need_digest:
                df = df.select("*", *of_part, F.regexp_extract(F.col("_metadata.file_path"), r"/data/([0-9a-f]{40})", 1).alias("_digest"))
            df = df.select(*(values[n] for n in self.schema), *(["_digest", "_part"] if need_digest else []))
            if not label:
                df = df.where(self._windows(some)) if need_digest else df
            else:
                # a table that several labels show is read once and given out to each
                rows = sorted({(s.digest, s.part or "", s.label) for s in some})
                of = spark.createDataFrame(rows, "_digest string, _part string, _l string")
                df = df.join(F.broadcast(of) if len(rows) <= BROADCAST_ROWS else of, ["_digest", "_part"])
                if len(some) > len(rows) or not all(s.whole for s in some):
                    cut = [s for s in some if not s.whole]
                    free = [F.struct(F.lit(s.digest), F.lit(s.part or ""), F.lit(s.label)) for s in some if s.whole]
                    key = F.struct(F.col("_digest"), F.col("_part"), F.col("_l"))
                    shown = [(F.col("_digest") == s.digest) & (F.col("_part") == (s.part or "")) & (F.col("_l") == s.label) & self._condition(s) for s in cut]
                    df = df.where(reduce(lambda a, b: a | b, [*([key.isin(free)] if free else []), *shown]))
                df = df.withColumnRenamed("_l", name)
            parts.append(df.select(*([F.col(name).alias("label")] if label and "label" not in self.schema.columns else [name] if label else []), *self.schema))
        if not parts:
            fields = [T.StructField("label", T.StringType())] if label else []
            return spark.createDataFrame([], T.StructType(fields + list(self.schema.struct)))
        return reduce(DataFrame.unionByName, parts)

    def _condition(self, s: Segment) -> Column:
        p = None if s.whole else s.interval.predicate(self.schema)
        return F.lit(True) if p is None else p

    def _windows(self, segments: list[Segment]) -> Column:
        """Which rows of the tables are shown. The hull of all windows stands first, as a plain range that the scan can push down."""
        by_table: dict[tuple[str, str], list[Segment]] = {}
        for s in segments:
            by_table.setdefault((s.digest, s.part or ""), []).append(s)
        key = F.struct("_digest", "_part")
        whole = [k for k, some in by_table.items() if any(s.whole for s in some)]
        each = [(F.col("_digest") == d) & (F.col("_part") == p) & reduce(lambda a, b: a | b, (self._condition(s) for s in some)) for (d, p), some in by_table.items() if (d, p) not in whole]
        keep = reduce(lambda a, b: a | b, ([key.isin([F.struct(F.lit(d), F.lit(p)) for d, p in whole])] if whole else []) + each)
        ordered = sorted((s.interval for s in segments), key=by_start)
        last = reduce(lambda a, b: b if ends_after(b, a) else a, ordered)
        hull = Interval(ordered[0].start, last.stop, Closed(ordered[0].closed.left, last.closed.right)).predicate(self.schema)
        return keep if hull is None else hull & keep

    # --- writing

    def put(self, writes: list, root: bool = False, sink: tuple[str, int] | None = None) -> list[Revision]:
        """Applies writes in their order: segments, or functions of the manifest as it is after those before. ``sink``: name and batch of a stream, remembered in the same revision."""
        if self._batch is not None and not root:
            self._batch += writes
            return []
        held, applied = Manifest(self.schema) if root else self.manifest(), 0
        ready: list[Segment] = []
        for w in writes:
            if callable(w):  # it has to see what came before
                held, ready = held.apply(*ready), []
                w = w(held)
            if w is not None:
                ready.append(w)
                applied += 1
        if sink:
            held = replace(held, sinks=tuple(sorted({**dict(held.sinks), sink[0]: sink[1]}.items())))
        elif not applied:
            return []
        return self.changelog.commit(held.apply(*ready).dumps(), [ROOT] if root else None)

    @contextmanager
    def multi(self, root: bool = False):
        """Writes in this block become one revision at its end; none if it raises. They count in the order they were called. Their rows are stored together, in one job and one table however many they are."""
        self._batch = []
        try:
            yield self
            batch, self._batch = self._batch, None
            self.put(self._stored(batch), root)
        finally:
            self._batch = None

    def _stored(self, batch: list) -> list:
        """The batch with its pending writes stored."""
        waiting = [w for w in batch if isinstance(w, Pending)]
        if not waiting:
            return batch
        if len(waiting) == 1:
            done = {id(w): w.series._segment(w.df, w.start, w.stop, w.closed, False) for w in waiting}
        else:
            rows = united([w.df.select(F.lit(f"{i} {w.series.label}").alias(PART), *self.schema) for i, w in enumerate(waiting)])
            checked = rows.select("*", F.when(holes(self.schema), F.raise_error(F.lit("a row has a null in the index"))).alias("_check")).where("_check is null").drop("_check")
            stored = {part: Stored(digest, n, first, last) for part, first, last, digest, n in self.repo.store_labelled(self._labelled_schema, checked)}
            done = {}
            for i, w in enumerate(waiting):
                part = f"{i} {w.series.label}"
                done[id(w)] = w.series._shown(stored.get(part, Stored("", 0, None, None)), w.start, w.stop, w.closed, part if part in stored else None)
        return [done[id(w)] if isinstance(w, Pending) else w for w in batch]

    def write(self, df: DataFrame, label_column: str = "label") -> list[Revision]:
        """Writes many series at once from one DataFrame with a column of labels: one table, one revision; each label shows its part of the table."""
        return self.put([Segment(label, Interval(first, last), digest, n, part=label) for label, first, last, digest, n in self.repo.store_labelled(self._labelled_schema, self._labelled(df, label_column))])

    def upsert(self, df: DataFrame, label_column: str = "label", sink: tuple[str, int] | None = None) -> list[Revision]:
        """Like write(), but rows that lie between the new ones stay: only those with the index of a new row are replaced. Of several new rows for one index the first by the other columns counts. Not within multi()."""
        new = self._labelled(df, label_column)
        spans = new.groupBy(PART).agg(F.min(F.struct(*self.schema.idx)).alias("a"), F.max(F.struct(*self.schema.idx)).alias("b")).collect()  # a row per label of the batch, as the manifest has
        held = self.manifest()
        old = self.scan([s for r in spans for s in held.visible(r[PART], Interval(tuple(r.a), tuple(r.b)))], label=True)
        name = "label" if "label" not in self.schema.columns else "_label"
        old = old.select(F.col(name).alias(PART), *self.schema)
        stored = self.repo.store_labelled(self._labelled_schema, kv_upsert(old, new, [PART, *self.schema.idx]))
        return self.put([Segment(label, Interval(first, last), digest, n, part=label) for label, first, last, digest, n in stored], sink=sink)

    @property
    def _labelled_schema(self) -> Schema:
        return Schema(**{PART: SchemaColumn(PART, "str", True), **self.schema.columns})

    def _labelled(self, df: DataFrame, label_column: str) -> DataFrame:
        have = {f.name: f.dataType for f in df.schema}
        typed = df.select(F.col(label_column).cast("string").alias(PART), *(c.cast(F.col(f"`{n}`"), have[n]).alias(n) for n, c in self.schema.columns.items())).where(F.col(PART).isNotNull())
        return typed.select("*", F.when(holes(self.schema), F.raise_error(F.lit("a row has a null in the index"))).alias("_check")).where("_check is null").drop("_check")

    def delete(self, *labels: str) -> list[Revision]:
        return self.changelog.commit(self.manifest().without(*labels).dumps())

    def rename(self, old: str, new: str) -> list[Revision]:
        """Gives a series another label; where that has rows in the same ranges, the renamed ones cover them."""
        m = self.manifest()
        if old not in m.labels:
            raise ValueError(f"no series {old!r}")
        return self.changelog.commit(m.without(old).apply(*(replace(s, label=new) for s in m.of(old))).dumps())

    def clone(self, target: Collection, rename: dict[str, str] | None = None, defaults: dict[str, Any] | None = None) -> list[Revision]:
        """Shows all series in an empty collection of another schema, with columns renamed, added (by default or zero) or dropped, on the same stored tables and in one revision."""
        rename, defaults = rename or {}, defaults or {}
        if target.manifest().segments:
            raise ValueError(f"collection {target.label!r} is not empty")
        have = {rename.get(n, n): n for n in self.schema}
        fill = {}
        for n, c in target.schema.columns.items():
            if n not in have:
                value = defaults.get(n, "" if isinstance(c.spark, T.StringType) else 0)
                fill[n] = json.dumps(c.to_json(c.value(value)))
        segments = []
        extra = [target.schema[n].from_json(json.loads(fill[n])) for n in target.schema.idx if n in fill]
        for s in self.manifest().segments:
            stored = dict(s.columns) if s.columns is not None else {n: n for n in self.schema}
            columns = {n: stored[have[n]] for n in target.schema if n in have and have[n] in stored}
            old = {n: v for n, v in s.fill}
            filled = {**{n: old[have[n]] for n in target.schema if n in have and have[n] in old}, **fill}
            position = {n: i for i, n in enumerate(self.schema.idx)}
            added = dict(zip([n for n in target.schema.idx if n in fill], extra))
            bound = lambda t: tuple(added[n] if n in added else t[position[have[n]]] for n in target.schema.idx)  # noqa: B023, E731
            segments.append(Segment(s.label, Interval(bound(s.interval.start), bound(s.interval.stop), s.interval.closed), s.digest, s.length, s.whole, s.part, tuple(sorted(columns.items())), tuple(sorted(filled.items()))))
        return target.changelog.commit(Manifest(target.schema, tuple(segments)).dumps(), [ROOT])

    # --- branches and upkeep

    def merge(self) -> list[Revision]:
        """Joins all branches: the oldest branch is the base, each newer one's own segments are written over it, so that the newest wins where they overlap."""
        self.refresh()
        heads = self.changelog.leafs()
        if len({h.child for h in heads}) < 2:
            return []
        common = self.changelog.common(heads)
        base = self.manifest(revision=heads[0])
        known = set(self.manifest(revision=common).segments) if common else set()
        known |= set(base.segments)
        merged = base.apply(*(s for head in heads[1:] for s in self.manifest(revision=head).sorted().segments if s not in known))
        return self.changelog.commit(merged.dumps(), list(dict.fromkeys(h.child for h in heads)))

    def digests(self, revisions: list[Revision] | None = None) -> set[str]:
        """Stored tables that revisions (by default all) refer to."""
        return {s.digest for r in (self.changelog.log() if revisions is None else revisions) for s in self.manifest(revision=r).segments}

    def pull(self, remote: Collection, shallow: bool = False) -> int:
        """Copies what the other has and this one lacks: tables first, then revisions. ``shallow``: the newest revisions only. Branches stay apart until merge()."""
        if remote.schema != self.schema:
            raise ValueError(f"schemas of {self.label!r} differ")
        remote.refresh()
        revisions = remote.changelog.leafs() if shallow else remote.changelog.log()
        have = set(self.repo.files.ls("data"))
        for digest in sorted(remote.digests(revisions) - have):
            self.repo.files.copy_from(remote.repo.files, f"data/{digest}")
        return self.changelog.pull(remote.changelog, shallow)

    def push(self, remote: Collection, shallow: bool = False) -> int:
        return remote.pull(self, shallow)

    def defrag(self, max_chunk: int = 4) -> list[Revision]:
        """Series of more than ``max_chunk`` segments are rewritten from the first short segment on, in files of at most PAGE rows; one revision for all."""
        m, todo = self.manifest(), []
        for label in m.labels:
            segments = m.of(label)
            if len(segments) <= max_chunk:
                continue
            short = min(PAGE, sum(s.length for s in segments) / (max_chunk + 1))
            at = next((i for i, s in enumerate(segments) if s.length < short or not s.whole), None)
            if at is not None and len(segments) - at >= 2:
                todo.append((label, segments[at:]))

        def rewritten(label: str, some: list[Segment]) -> Segment:
            stored = self.repo.store(self.schema, self.scan(some), rows_per_file=PAGE)
            first, last = some[0].interval, some[-1].interval
            return Segment(label, Interval(first.start, last.stop, Closed(first.closed.left, last.closed.right)), stored.digest, stored.length)

        if not todo:
            return []
        with ThreadPoolExecutor(8) as pool:
            new = list(pool.map(lambda x: rewritten(*x), todo))
        return self.changelog.commit(m.apply(*new).dumps())

    def trim(self, before: dt.datetime | None = None) -> int:
        """Removes revisions older than a time (by default 20 minutes ago), never the newest; how many. Data goes with gc()."""
        limit = int((before.replace(tzinfo=before.tzinfo or dt.timezone.utc) if before else dt.datetime.now(dt.timezone.utc) - dt.timedelta(seconds=2 * TIMEOUT)).timestamp() * 1000)
        log, leaf = self.changelog.log(), self.changelog.leaf()
        old = {r.name for r in log if r.epoch_ms < limit and r.child != leaf.child}
        for name in old:
            self.repo.files.remove(f"{self.changelog.folder}/{name}")
        self.refresh()
        return len(old)

    def squash(self, trim: bool = True, max_chunk: int = 4) -> list[Revision]:
        out = self.defrag(max_chunk)
        if trim:
            self.trim(dt.datetime.now(dt.timezone.utc) + dt.timedelta(seconds=1))
        return out


class Stored:
    def __init__(self, digest: str, length: int, first: tuple | None, last: tuple | None):
        self.digest, self.length, self.first, self.last = digest, length, first, last


@dataclass
class Pending:
    """A write that waits for the end of its block."""

    series: Series
    df: DataFrame
    start: Any
    stop: Any
    closed: Any


class Repo:
    """A store of collections at a URI, with namespaces."""

    def __init__(self, spark: SparkSession, uri: str):
        self.spark, self.files = spark, Files(spark, uri)
        self.registry = Changelog(self.files, "registry/_log")

    # --- collections

    def _catalog(self) -> dict[str, dict[str, dict]]:
        return self._catalog_at(self.registry.leaf())

    def _catalog_at(self, revision: Revision | None) -> dict[str, dict[str, dict]]:
        return json.loads(self.registry.read(revision)) if revision else {}

    def _save(self, catalog: dict) -> None:
        self.registry.commit(json.dumps(catalog))

    def refresh(self) -> None:
        self.registry.refresh()

    def ls(self, namespace: str = "collection") -> list[str]:
        return sorted(self._catalog().get(namespace, {}))

    def __iter__(self) -> Iterator[Collection]:
        return (self.collection(x) for x in self.ls())

    def search(self, label: str | None = None, namespace: str = "collection") -> list[Collection]:
        return [self.collection(x, namespace) for x in self.ls(namespace) if label is None or x == label]

    def collection(self, label: str, namespace: str = "collection") -> Collection | None:
        meta = self._catalog().get(namespace, {}).get(label)
        return Collection(self, label, Schema.loads(json.dumps(meta["schema"])), meta["path"]) if meta else None

    __truediv__ = collection

    def create_collection(self, schema: Schema, *labels: str, raise_if_exists: bool = True, namespace: str = "collection") -> Collection | list[Collection]:
        catalog = self._catalog()
        known = catalog.setdefault(namespace, {})
        for label in labels:
            if not isinstance(label, str) or not label.strip() or label != label.strip():
                raise ValueError(f"{label!r} is no label for a collection")
            if label in known:
                if raise_if_exists:
                    raise ValueError(f"collection {label!r} exists")
                if Schema.loads(json.dumps(known[label]["schema"])) != schema:
                    raise ValueError(f"collection {label!r} has another schema")
        for label in labels:
            known.setdefault(label, {"path": uuid.uuid4().hex, "schema": json.loads(schema.dumps())})
        self._save(catalog)
        made = [self.collection(label, namespace) for label in labels]
        return made[0] if len(made) == 1 else made

    def delete(self, *labels: str, namespace: str = "collection") -> None:
        catalog = self._catalog()
        for label in labels:
            meta = catalog.get(namespace, {}).pop(label, None)
            if meta:
                self.files.remove(f"collections/{meta['path']}")
        self._save(catalog)

    def rename(self, old: str, new: str, namespace: str = "collection") -> None:
        catalog = self._catalog()
        known = catalog.get(namespace, {})
        if old not in known:
            raise ValueError(f"no collection {old!r}")
        if new in known:
            raise ValueError(f"collection {new!r} exists")
        known[new] = known.pop(old)
        self._save(catalog)

    def archive(self, label: str) -> None:
        """Moves a collection to the namespace ``archive``."""
        catalog = self._catalog()
        if label not in catalog.get("collection", {}):
            raise ValueError(f"no collection {label!r}")
        if label in catalog.get("archive", {}):
            raise ValueError(f"an archived collection {label!r} exists")
        catalog.setdefault("archive", {})[label] = catalog["collection"].pop(label)
        self._save(catalog)

    def merge(self) -> list[Revision]:
        """Joins the branches of the registry: what any branch has added, changed or removed since they parted; the newest wins."""
        self.refresh()
        heads = self.registry.leafs()
        if len({h.child for h in heads}) < 2:
            return []
        read = lambda r: {(namespace, label): meta for namespace, known in json.loads(self.registry.read(r)).items() for label, meta in known.items()}
        common = self.registry.common(heads)
        base = read(common) if common else {}
        flat = dict(base)
        for h in heads:
            theirs = read(h)
            flat.update({k: v for k, v in theirs.items() if base.get(k) != v})
            for k in base.keys() - theirs.keys():
                flat.pop(k, None)  # what a branch has removed stays removed
        merged: dict = {}
        for (namespace, label), meta in flat.items():
            merged.setdefault(namespace, {})[label] = meta
        return self.registry.commit(json.dumps(merged), list(dict.fromkeys(h.child for h in heads)))

    def pull(self, remote: Repo, *labels: str, shallow: bool = False) -> None:
        """Creates what is missing and pulls each collection."""
        remote.refresh()
        for label in labels or remote.ls():
            theirs = remote.collection(label)
            if theirs is None:
                raise ValueError(f"no collection {label!r}")
            mine = self.collection(label) or self.create_collection(theirs.schema, label)
            mine.pull(theirs, shallow)

    def push(self, remote: Repo, *labels: str, shallow: bool = False) -> None:
        remote.pull(self, *labels, shallow=shallow)

    # --- stored tables

    def data_uris(self, digests) -> list[str]:
        """Folders of tables; of many, the store is asked once for all."""
        digests = list(digests)
        there = set(self.files.ls("data")) if len(digests) > 8 else set()
        return [self.files.uri(f"data/{d}" if d in there else self.data_path(d)) for d in digests]

    def data_path(self, digest: str) -> str:
        """Folder of a table, also if a collection of garbage has set it aside."""
        path = f"data/{digest}"
        if not self.files.exists(path):
            aside = [n for n in self.files.ls("data") if n.startswith(f"{digest}.")]
            if not aside:
                raise FileNotFoundError(path)
            return f"data/{aside[0]}"
        return path

    def store(self, schema: Schema, df: DataFrame, presorted: bool = False, rows_per_file: int = 0) -> Stored:
        """Writes rows once and learns their number, first and last index and checksum in the same pass."""
        df = complete(schema, df)
        if not presorted:
            df = df.sort(*schema.idx)
        seen = Observation()
        h = F.xxhash64(*(F.col(f"`{n}`") for n in schema))
        idx = F.struct(*(F.col(f"`{n}`") for n in schema.idx))
        df = df.observe(seen, F.count(F.lit(1)).alias("n"), F.min(idx).alias("a"), F.max(idx).alias("b"), F.count_if(holes(schema)).alias("holes"), *checksums(h))
        aside = f"_writing/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(self.files.uri(aside))
        m = seen.get
        if not m["n"]:
            self.files.remove(aside)
            return Stored("", 0, None, None)
        if m["holes"]:
            self.files.remove(aside)
            raise ValueError(f"{m['holes']} rows have a null in the index")
        digest = hashlib.sha1(f"{schema.dumps()}|{m['n']}|{m['s']}|{m['u']}|{m['x']}".encode()).hexdigest()
        if self.files.exists(f"data/{digest}"):
            self.files.remove(aside)
        else:
            self.files.rename(aside, f"data/{digest}")
        return Stored(digest, m["n"], tuple(m["a"]), tuple(m["b"]))

    def store_labelled(self, schema: Schema, df: DataFrame) -> list[tuple[str, tuple, tuple, str, int]]:
        """Writes many series into one table, sorted by label and index, and returns (label, first, last, digest, rows) by label. Files have the size that adaptive execution aims at, however many labels there are."""
        idx = [n for n in schema.idx if n != PART]
        aside = f"_writing/{uuid.uuid4().hex}"
        df.hint("rebalance", PART).sortWithinPartitions(PART, *idx).write.option("compression", "zstd").parquet(self.files.uri(aside))
        back = self.spark.read.schema(schema.struct).parquet(self.files.uri(aside))
        key = F.struct(*(F.col(f"`{n}`") for n in idx))
        stats = back.groupBy(PART).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("a"), F.max(key).alias("b"), *checksums(F.xxhash64(*(F.col(f"`{n}`") for n in schema)))).collect()  # one row per series: what the manifest holds anyway
        if not stats:
            self.files.remove(aside)
            return []
        xor = reduce(lambda a, b: a ^ b, (r.x for r in stats))
        digest = hashlib.sha1(f"{schema.dumps()}|{sum(r.n for r in stats)}|{sum(r.s for r in stats)}|{sum(r.u for r in stats)}|{xor}".encode()).hexdigest()
        if self.files.exists(f"data/{digest}"):
            self.files.remove(aside)
        else:
            self.files.rename(aside, f"data/{digest}")
        return [(r[PART], tuple(r.a), tuple(r.b), digest, r.n) for r in stats]

    def gc(self, timeout: float = TIMEOUT) -> tuple[int, int]:
        """Sets tables aside that no revision of any collection refers to; removes those set aside longer than ``timeout`` seconds ago, or takes them back if they are wanted again. (removed, set aside)"""
        catalog = self._catalog()
        wanted: set[str] = set()
        for namespace in catalog:
            for label in catalog[namespace]:
                c = self.collection(label, namespace)
                wanted |= c.digests()
        hard = soft = 0
        for name in self.files.ls("data"):
            digest, _, since = name.partition(".")
            if since:
                if digest in wanted:
                    self.files.rename(f"data/{name}", f"data/{digest}")
                elif int(since, 16) + timeout * 1000 <= int(hextime(), 16):
                    self.files.remove(f"data/{name}")
                    hard += 1
            elif digest not in wanted:
                self.files.rename(f"data/{name}", f"data/{digest}.{hextime()}")
                soft += 1
        return hard, soft


def holes(schema: Schema) -> Column:
    """Whether a row lacks an index value: it has no place in a series."""
    return reduce(lambda a, b: a | b, (F.col(f"`{n}`").isNull() for n in schema.idx))


def checksums(h: Column) -> list[Column]:
    """Sums of two parts of a hash, short enough for 10^11 rows, and its exclusive or: the same for the same rows in any order and any number of copies."""
    return [F.sum(h.bitwiseAND(F.lit(0xFFFFFF))).alias("s"), F.sum(F.shiftrightunsigned(h, 40)).alias("u"), F.bit_xor(h).alias("x")]


def complete(schema: Schema, df: DataFrame) -> DataFrame:
    missing = [n for n in schema if n not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    return df.select(*(F.col(f"`{n}`") for n in schema))


def chosen(df: DataFrame, select: str | list[str] | None) -> DataFrame:
    if not select:
        return df
    keep = [select] if isinstance(select, str) else list(select)
    unknown = [c for c in keep if c not in df.columns]
    if unknown:
        raise ValueError(f"unknown columns: {unknown}")
    return df.select(*(f"`{c}`" for c in df.columns if c in keep))
