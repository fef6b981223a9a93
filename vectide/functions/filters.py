"""Predicates over metadata maps, and id sets."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectide.schema import VectorError

#: An internet date-time with its zone; the fraction is optional.
ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})$"


def parse_date(text: Column) -> Column:
    """A timestamp, or null for anything that is no full internet date-time."""
    return F.when(text.rlike(ISO), F.try_to_timestamp(text))


def parse_tags(text: Column, delimiter: str = ",", trim: bool = True) -> Column:
    parts = F.split(text, "[" + ("\\" + delimiter if delimiter in "^]\\-[" else delimiter) + "]")
    parts = F.transform(parts, lambda t: F.trim(t)) if trim else parts
    return F.filter(parts, lambda t: t != "")


@dataclass(frozen=True)
class MetadataFilter:
    """A predicate over a map of strings, built step by step; ``column`` makes it an expression.

    A missing map answers ``missing``.  A missing tags key answers true at once where missing keys
    are allowed, without the further predicates; a missing date key only skips the date test.  An
    empty list of wanted tags rejects all in ``any`` mode and none in ``all`` mode.
    """

    first: datetime | None = None
    last: datetime | None = None
    wanted: tuple[str, ...] | None = None
    wanted_all: bool = False
    unwanted: tuple[str, ...] | None = None
    missing: bool = False
    date_key: str = "date"
    tags_key: str = "tags"
    delimiter: str = ","
    trim: bool = True
    further: tuple = ()

    def between(self, first: datetime, last: datetime) -> MetadataFilter:
        return replace(self, first=first, last=last)

    def including(self, tags: Sequence[str], every: bool = False) -> MetadataFilter:
        return replace(self, wanted=tuple(tags), wanted_all=every)

    def excluding(self, tags: Sequence[str]) -> MetadataFilter:
        return replace(self, unwanted=tuple(tags))

    def allow_missing(self, allow: bool = True) -> MetadataFilter:
        return replace(self, missing=allow)

    def keys(self, date: str = "date", tags: str = "tags", delimiter: str = ",") -> MetadataFilter:
        if len(delimiter) != 1:
            raise VectorError("invalid_parameter", "a delimiter is one character", "filter", delimiter=delimiter)
        return replace(self, date_key=date, tags_key=tags, delimiter=delimiter)

    def also(self, predicate) -> MetadataFilter:
        """``predicate``: from the metadata column to a boolean column."""
        return replace(self, further=(*self.further, predicate))

    def column(self, metadata: Column | str = "metadata") -> Column:
        m = F.col(metadata) if isinstance(metadata, str) else metadata
        allowed, passes = F.lit(self.missing), F.lit(True)
        for predicate in reversed(self.further):
            passes = F.when(F.coalesce(predicate(m), F.lit(False)), passes).otherwise(F.lit(False))
        if self.wanted is not None or self.unwanted is not None:
            text = F.try_element_at(m, F.lit(self.tags_key))
            tags, ok = parse_tags(text, self.delimiter, self.trim), F.lit(True)
            if self.wanted is not None:
                wanted = F.array(*map(F.lit, self.wanted)).cast("array<string>")
                if self.wanted_all:
                    ok = ok & (F.size(F.array_except(wanted, tags)) == 0)
                else:
                    ok = ok & (F.arrays_overlap(wanted, tags) if self.wanted else F.lit(False))
            if self.unwanted:
                ok = ok & ~F.arrays_overlap(F.array(*map(F.lit, self.unwanted)), tags)
            passes = F.when(text.isNull(), allowed).when(F.coalesce(ok, F.lit(False)), passes).otherwise(F.lit(False))
        if self.first is not None or self.last is not None:
            text = F.try_element_at(m, F.lit(self.date_key))
            date, ok = parse_date(text), F.lit(True)
            ok = ok if self.first is None else ok & (date >= F.lit(self.first.astimezone(timezone.utc)))
            ok = ok if self.last is None else ok & (date <= F.lit(self.last.astimezone(timezone.utc)))
            passes = F.when(text.isNull(), passes if self.missing else F.lit(False)).when(F.coalesce(ok, F.lit(False)), passes).otherwise(F.lit(False))
        return F.when(m.isNull(), allowed).otherwise(passes)


def id_pass(df: DataFrame, allows: Sequence[DataFrame] = (), denies: Sequence[DataFrame] = (), capacity: int | None = None, id_col: str = "id") -> DataFrame:
    """Rows whose id is in each allow set and in no deny set; ids outside ``[0, capacity)`` fail even where only deny sets are given."""
    if capacity is not None and (allows or denies):
        df = df.where(F.col(id_col).between(0, capacity - 1))
    for allowed in allows:
        df = df.join(allowed.select(id_col).distinct(), id_col, "left_semi")
    for denied in denies:
        df = df.join(denied.select(id_col).distinct(), id_col, "left_anti")
    return df


def id_mask(df: DataFrame, allows: Sequence[DataFrame] = (), denies: Sequence[DataFrame] = (), capacity: int | None = None, id_col: str = "id", mask_col: str = "mask") -> DataFrame:
    """df with 1 where ``id_pass`` would keep the row, else 0."""
    ok = F.col(id_col).isNotNull()
    if capacity is not None and (allows or denies):
        ok = ok & F.col(id_col).between(0, capacity - 1)
    marks = []
    for k, (ids, wanted) in enumerate([*((a, True) for a in allows), *((d, False) for d in denies)]):
        mark = f"_in{k}"
        df = df.join(ids.select(id_col).distinct().withColumn(mark, F.lit(1)), id_col, "left")
        ok = ok & (F.col(mark).isNotNull() if wanted else F.col(mark).isNull())
        marks.append(mark)
    return df.withColumn(mask_col, ok.cast("int")).drop(*marks)


def id_overlay(df: DataFrame, *, allow: Sequence[DataFrame] = (), deny: DataFrame | None = None, query_allow: DataFrame | None = None, query_deny: DataFrame | None = None, capacity: int | None = None, id_col: str = "id") -> DataFrame:
    """Layers of policy: global and query-level sets together; all allow sets hold, and no deny set."""
    allows = [*allow, *([query_allow] if query_allow is not None else [])]
    denies = [d for d in (deny, query_deny) if d is not None]
    return id_pass(df, allows, denies, capacity, id_col)
