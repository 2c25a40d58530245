"""Un-aggregated rows: NULL-padded union, counts and stable pages."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewell.functions.time import in_range, utc_literal

# Pages ending at or below this row are taken with one top-k; deeper ones seek first.
DIRECT_PAGE_ROWS = 100_000
SEEK_WIDTHS = (
    timedelta(days=1),
    timedelta(hours=1),
    timedelta(minutes=1),
    timedelta(seconds=1),
    timedelta(milliseconds=1),
    timedelta(microseconds=1),
)


def raw_rows(
    readings: DataFrame,
    wanted: dict[str, list[str]],
    *,
    start: datetime | str | None = None,
    end: datetime | str | None = None,
    extra: tuple[str, ...] = (),
) -> DataFrame:
    """``tool_id, ts`` and the sorted union of all wanted sensors, in one scan over all tools.

    A sensor a tool was not asked for, or that no file holds, is NULL for that tool.
    """
    present = set(readings.columns)
    displayed = sorted({name for names in wanted.values() for name in names})
    cells = []
    for name in displayed:
        tools = [tool for tool, names in wanted.items() if name in names]
        if name not in present:
            cell = F.lit(None).cast("double")
        elif len(tools) == len(wanted):
            cell = _quoted(name)
        else:
            cell = F.when(F.col("tool_id").isin(tools), _quoted(name))
        cells.append(cell.alias(name))
    scoped = readings.where(F.col("tool_id").isin(list(wanted))).where(
        in_range(F.col("ts"), start, end)
    )
    return scoped.select("tool_id", "ts", *cells, *extra)


def union_padded(frames: list[DataFrame]) -> DataFrame:
    """``UNION ALL`` of differently shaped readings, sensors sorted by name, gaps as NULL."""
    united = frames[0]
    for frame in frames[1:]:
        united = united.unionByName(frame, allowMissingColumns=True)
    sensors = sorted(c for c in united.columns if c not in ("tool_id", "ts"))
    return united.select("tool_id", "ts", *[_quoted(c) for c in sensors])


def raw_counts(
    readings: DataFrame,
    *,
    tools: list[str] | None = None,
    start: datetime | str | None = None,
    end: datetime | str | None = None,
) -> DataFrame:
    """Rows in range per tool; reads no sensor column."""
    scoped = readings if tools is None else readings.where(F.col("tool_id").isin(tools))
    return (
        scoped.where(in_range(F.col("ts"), start, end))
        .groupBy("tool_id")
        .agg(F.count("*").alias("rows"))
    )


def total_order(rows: DataFrame, order: str = "asc") -> list[Column]:
    """Sort keys that leave no ties but between equal rows: time, tool, then every column."""
    first = F.col("ts").asc() if order == "asc" else F.col("ts").desc()
    rest = [c for c in rows.columns if c not in ("ts", "tool_id")]
    return [first, F.col("tool_id").asc(), *[_quoted(c).asc() for c in rest]]


def page(
    rows: DataFrame,
    *,
    offset: int,
    limit: int,
    order: str = "asc",
    direct_rows: int = DIRECT_PAGE_ROWS,
) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of the total order.

    Rows without a time come first in rising order and last in falling order, at any depth. A
    shallow page is one distributed top-k. For a deep one, counts per day, then hour, minute and
    so on move the start of the scan close to the page before the top-k runs; both ways give the
    same rows.
    """
    if offset + limit <= direct_rows:
        return rows.orderBy(*total_order(rows, order)).offset(offset).limit(limit)
    held, skipped = _seek(rows, offset, limit, order, direct_rows)
    return held.orderBy(*total_order(rows, order)).offset(offset - skipped).limit(limit)


def page_after(
    rows: DataFrame,
    *,
    last_ts: datetime | str | None,
    last_tool: str,
    limit: int,
    order: str = "asc",
    given: int | None = None,
) -> DataFrame:
    """Next rows behind a ``(ts, tool_id)`` position; cost does not grow with depth.

    ``last_ts`` is None behind a row without a time, which has its place as in :func:`page`.
    ``given`` is the number of rows of that very time and tool on the pages so far; the rest of
    them, equal rows too, come first on this page. Without it all of them count as given.
    """
    ts, tool = F.col("ts"), F.col("tool_id") > last_tool
    if given is not None:
        tool = F.col("tool_id") >= last_tool
    if last_ts is None:
        beyond = (ts.isNull() & tool) | (ts.isNotNull() if order == "asc" else F.lit(False))
        return rows.where(beyond).orderBy(*total_order(rows, order)).offset(given or 0).limit(limit)
    bound = utc_literal(last_ts)
    later = ts > bound if order == "asc" else (ts < bound) | ts.isNull()
    # The first condition repeats the time bound alone so that it reaches the scan.
    reach = ts >= bound if order == "asc" else (ts <= bound) | ts.isNull()
    return (
        rows.where(reach)
        .where(later | ((ts == bound) & tool))
        .orderBy(*total_order(rows, order))
        .offset(given or 0)
        .limit(limit)
    )


def _seek(
    rows: DataFrame, offset: int, limit: int, order: str, direct_rows: int
) -> tuple[DataFrame, int]:
    """Cut ``rows`` to a stretch of the order that starts close before the page.

    Returns the stretch and the number of rows before it.
    """
    undated, dated = rows.where(F.col("ts").isNull()), rows.where(F.col("ts").isNotNull())
    if order == "asc":
        before = undated.count()
        if offset >= before:
            held, skipped, _ = _seek_dated(dated, offset - before, limit, order, direct_rows)
            return held, skipped + before
        held, skipped = _skip_tools(undated, offset, 0)
        rest = offset + limit - before
        if rest > 0:
            held = held.union(_seek_dated(dated, 0, rest, order, direct_rows)[0])
        return held, skipped
    held, skipped, total = _seek_dated(dated, offset, limit, order, direct_rows)
    if total is None:
        return held, skipped
    if offset >= total:
        return _skip_tools(undated, offset, total)
    return held.union(undated), skipped


def _seek_dated(
    rows: DataFrame, offset: int, limit: int, order: str, direct_rows: int
) -> tuple[DataFrame, int, int | None]:
    """As :func:`_seek` for rows with a time, and their number where the page reaches beyond.

    Every step counts only inside the one slot that holds the page's first row, so a step
    returns few counts whatever the data size.
    """
    falling = order == "desc"
    last = offset + limit
    low, high, skipped, total = None, None, 0, None
    slot_low, slot_high = None, None
    for width in SEEK_WIDTHS:
        label = F.window("ts", f"{width // timedelta(microseconds=1)} microseconds")["start"]
        counts = (
            rows.where(in_range(F.col("ts"), slot_low, slot_high))
            .groupBy(label.alias("slot"))
            .count()
            .collect()
        )
        position, first_slot, last_slot = skipped, None, None
        for row in sorted(counts, key=lambda r: r["slot"], reverse=falling):
            after = position + row["count"]
            if first_slot is None and after > offset:
                first_slot, skipped = row["slot"], position
            if last_slot is None and after >= last:
                last_slot = row["slot"]
            position = after
        if slot_low is None and position < last:
            total = position
        if first_slot is None:
            return rows.where(F.lit(False)), offset, total
        slot_low, slot_high = first_slot, first_slot + width
        if falling:
            high, low = slot_high, last_slot or low
        else:
            low, high = slot_low, last_slot + width if last_slot else high
        if last - skipped <= direct_rows:
            return rows.where(in_range(F.col("ts"), low, high)), skipped, total
    # Only rows sharing one timestamp are left to skip: skip whole tools among them.
    at_start = F.col("ts") == utc_literal(slot_low)
    tied, skipped = _skip_tools(rows.where(at_start), offset, skipped)
    return rows.where(in_range(F.col("ts"), low, high)).where(~at_start).union(tied), skipped, total


def _skip_tools(rows: DataFrame, offset: int, skipped: int) -> tuple[DataFrame, int]:
    """Leave out whole tools among rows of one time; the running count stays on the executors."""
    upto = Window.orderBy(F.col("tool_id").asc_nulls_first())
    at = (
        rows.groupBy("tool_id")
        .count()
        .select("tool_id", "count", F.sum("count").over(upto).alias("upto"))
        .where(F.col("upto") + skipped > offset)
        .orderBy("upto")
        .first()
    )
    if at is None:
        return rows.where(F.lit(False)), offset
    if at["tool_id"] is None:
        return rows, skipped
    return rows.where(F.col("tool_id") >= at["tool_id"]), skipped + at["upto"] - at["count"]


def _quoted(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")
