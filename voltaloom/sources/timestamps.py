"""Timestamps that a user states for folders of recordings, in any form, as one table."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import datetime, timedelta
from pathlib import PurePath

from pyspark.sql import DataFrame, SparkSession

#: A time, times in order of a folder's files, or a function of the folder that gives either.
Stated = datetime | list[datetime] | Callable[[str], "Stated"]
TABLE = "session string, position long, ts timestamp_ntz"


def resolve(stated: Stated, folder: str) -> datetime | list[datetime]:
    """Call functions until a time or a list of times is left; anything else is a TypeError that names the folder."""
    calls = 0
    while callable(stated):
        if (calls := calls + 1) > 100:
            raise TypeError(f"{folder}: a timestamp function gives functions without end")
        try:
            stated = stated(folder)
        except Exception as e:
            raise ValueError(f"{folder}: the timestamp function failed: {e}") from e
    if isinstance(stated, datetime):
        return stated
    odd = [type(x).__name__ for x in stated if not isinstance(x, datetime)] if isinstance(stated, list) else [type(stated).__name__]
    if odd:
        raise TypeError(f"{folder}: {sorted(set(odd))} are no timestamps")
    return stated


def timestamp_table(spark: SparkSession, stated: Stated | dict[str, Stated], folders: Iterable[str], seconds: dict[str, float] | None = None) -> DataFrame:
    """(session, position, ts) of folders. Position counts a folder's files from 0; it is null where one time stands for the folder's start.

    One time for all: folders follow one another from it in the given order, each `seconds` long; without its seconds a folder is an error. A mapping goes by folder name; folders that
    it lacks have no rows, names that no folder or several folders have are an error. A list or a function holds for every folder.
    There is a row a folder or file, so they are made on the driver.
    """
    folders = list(folders)
    rows: list[tuple[str, int | None, datetime]] = []

    def add(folder: str, value: datetime | list[datetime]) -> None:
        rows.extend([(folder, None, value)] if isinstance(value, datetime) else [(folder, i, t) for i, t in enumerate(value)])

    if isinstance(stated, dict):
        by_name: dict[str, list[str]] = {}
        for f in folders:
            by_name.setdefault(PurePath(f).name, []).append(f)
        for name, value in stated.items():
            found = by_name.get(name, [])
            if len(found) != 1:
                raise ValueError(f"{name!r} names {len(found)} folders; there are {sorted(by_name)}")
            add(found[0], resolve(value, found[0]))
    elif isinstance(stated, datetime):
        at = stated
        for f in folders:
            if f not in (seconds or {}):
                raise ValueError(f"{f}: its length is not known, so the next folder has no start")
            add(f, at)
            at += timedelta(seconds=seconds[f])
    else:
        for f in folders:
            add(f, resolve(stated, f))
    return spark.createDataFrame(rows, TABLE)
