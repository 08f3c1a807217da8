"""Names, paths and units: driver-side parsers, and the same as column expressions where tables need them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime
from functools import reduce
from itertools import chain
from pathlib import PurePath

from pyspark.sql import Column
from pyspark.sql import functions as F

from voltaloom import constants as C

DEFAULT_DAY = datetime(2000, 1, 1)
#: Dates up to this year are taken for something else.
LAST_ODD_YEAR = 1980
# What is no part of a date in a folder's name.
NOT_DATE = [r"[A-Z]+\d+", r"\([0-9]+\)", r"(?:\b\d\s){1,}(\d\b)?", r"\s\d$"]
#: How many neighbouring tokens may name a day, by mode and in order of trial; 0 stands for the whole text.
WIDTHS = {"full": (0,), "split": (1,), "window": (2, 3, 4), "all": (0, 1, 2, 3, 4)}


@dataclass(frozen=True)
class Vocabulary:
    """Aliases and the keys they stand for. In a text the longest alias decides, and of equally long ones the first key in order."""

    rules: tuple[tuple[str, str], ...]

    @classmethod
    def of(cls, aliases: dict[str, list[str]]) -> Vocabulary:
        return cls(tuple(sorted(((alias, key) for key, names in aliases.items() for alias in names), key=lambda rule: (-len(rule[0]), rule[1]))))

    def keys_in(self, text: str) -> list[str]:
        """Distinct keys of the aliases that text holds, the deciding one first."""
        return list(dict.fromkeys(key for alias, key in self.rules if alias in text))

    def keys_in_col(self, text: Column) -> Column:
        """The same as an array column."""
        rules = F.array(*(F.struct(F.lit(alias).alias("alias"), F.lit(key).alias("key")) for alias, key in self.rules))
        return F.array_distinct(F.transform(F.filter(rules, lambda rule: F.contains(text, rule["alias"])), lambda rule: rule["key"]))


def _only(keys: list[str], text: str, strict: bool) -> str:
    if not keys:
        raise ValueError(f"{text!r} has no known alias")
    if strict and len(keys) > 1:
        raise ValueError(f"{text!r} is ambiguous: {sorted(keys)}")
    return keys[0]


def alias_key(text: str, aliases: dict[str, list[str]], strict: bool = True) -> str:
    """The key that text names; if strict, a second key is an error."""
    return _only(Vocabulary.of(aliases).keys_in(text), text, strict)


def channel_abbreviation(name: str, from_number: bool = False, strict: bool = True) -> str:
    """Side and region of a channel's name; abbreviations stand for themselves, and its last number can decide where its words do not."""
    if name in set(C.CHANNEL_BY_NUMBER.values()):
        return name
    parts = [Vocabulary.of(aliases).keys_in(name) for aliases in (C.SIDES, C.REGIONS)]
    clear = all(keys and (len(keys) == 1 or not strict) for keys in parts)
    numbers = re.findall(r"\d+", name) if from_number and not clear else []
    return C.CHANNEL_BY_NUMBER[int(numbers[-1])] if numbers else "".join(_only(keys, name, strict) for keys in parts)


def channel_abbreviation_col(name: Column, from_number: bool = False, strict: bool = True) -> Column:
    """The same as a column; null where a name is unknown or, if strict, ambiguous."""
    side, region = (Vocabulary.of(aliases).keys_in_col(name) for aliases in (C.SIDES, C.REGIONS))
    clear = lambda keys: (F.size(keys) == 1) if strict else (F.size(keys) > 0)
    known = F.array(*(F.lit(v) for v in C.CHANNEL_BY_NUMBER.values()))
    by_number = F.create_map(*(F.lit(x) for pair in C.CHANNEL_BY_NUMBER.items() for x in pair))
    last = F.try_element_at(F.regexp_extract_all(name, F.lit(r"(\d+)"), 1), F.lit(-1)).cast("int")
    out = F.when(F.array_contains(known, name), name).when(clear(side) & clear(region), F.concat(F.get(side, F.lit(0)), F.get(region, F.lit(0))))
    return out.otherwise(F.try_element_at(by_number, last)) if from_number else out


def genotype_of(text: str, aliases: dict[str, list[str]] = C.GENOTYPES, strict: bool = True) -> str:
    return alias_key(text, aliases, strict)


def animal_id(text: str, rule: tuple[int, str] | str | list[str]) -> str:
    """By place (index, separator), by regular expression (first match), or the first of a list that occurs."""
    if isinstance(rule, tuple):
        return text.split(rule[1])[rule[0]]
    found = [m.group() for m in [re.search(rule, text)] if m] if isinstance(rule, str) else [name for name in rule if name in text]
    if not found:
        raise ValueError(f"{rule!r} finds nothing in {text!r}")
    return found[0]


def _date_texts(clean: str, sep: str | None, mode: str) -> Iterator[str]:
    """The parts of a text that may name a day, in order of trial."""
    tokens = clean.split(sep)
    for width in WIDTHS[mode]:
        yield from [clean] if width == 0 else (" ".join(tokens[i : i + width]) for i in range(len(tokens) - width + 1))


def _read_day(text: str) -> datetime | None:
    from dateutil import parser

    try:
        day = parser.parse(text, default=DEFAULT_DAY, fuzzy=True)
    except (parser.ParserError, OverflowError):
        return None
    return day if day.year > LAST_ODD_YEAR else None


def day_of(text: str, sep: str | None = None, mode: str = "split", patterns: list[tuple[str, str]] | None = None) -> datetime:
    """The day that text names: by the first (regex, format) pair that matches where tokens are tried, else by the first part that reads as a day."""
    if mode not in WIDTHS:
        raise ValueError(f"unknown mode {mode!r}")
    clean = " ".join(reduce(lambda left, odd: re.sub(odd, " ", left), NOT_DATE, text).split())
    stated = ((re.search(pattern, clean), form) for pattern, form in patterns or [] if 1 in WIDTHS[mode])
    days = chain((datetime.strptime(found.group(), form) for found, form in stated if found), filter(None, map(_read_day, _date_texts(clean, sep, mode))))
    for day in days:
        return day
    raise ValueError(f"no date in {text!r}")


def session_of(path: str, mode: str = "concat", rule: tuple[int, str] | str | list[str] = (0, " "), sep: str | None = None, patterns=None) -> dict[str, str]:
    """animal, genotype, day and animalday of a session folder; nest: the parent folder names animal and genotype; noday: no date is sought."""
    p = PurePath(path)
    whose = p.parent.name if mode == "nest" else p.name
    day = DEFAULT_DAY if mode == "noday" else day_of(p.name, sep, patterns=patterns)
    out = {"animal": animal_id(whose, rule), "genotype": genotype_of(whose), "day": day.strftime("%b-%d-%Y")}
    return out | {"animalday": f"{out['animal']} {out['genotype']} {out['day']}"}


def animalday(animal: Column, genotype: Column, day: Column) -> Column:
    """A session's name, as session_of gives it."""
    return F.concat_ws(" ", animal, genotype, F.date_format(day, "MMM-dd-yyyy"))


def file_index(path: str) -> int:
    """The last number of a file's stem, without the markers of recording files."""
    stem = re.sub(r"_(RowMajor|ColMajor|Meta)", "", PurePath(path).name.split(".")[0])
    return int(re.findall(r"\d+", stem)[-1])


def row_major_path(path: str) -> str:
    return re.sub(r"_ColMajor\.bin$", "_RowMajor.npy.gz", path)


def file_index_col(path: Column) -> Column:
    stem = F.regexp_replace(F.substring_index(F.element_at(F.split(path, "/"), -1), ".", 1), "_(RowMajor|ColMajor|Meta)", "")
    return F.element_at(F.regexp_extract_all(stem, F.lit(r"(\d+)"), 1), -1).cast("int")


def alias_col(text: Column, aliases: dict[str, list[str]]) -> Column:
    """Key of the longest alias that text contains; null if none."""
    return F.get(Vocabulary.of(aliases).keys_in_col(text), F.lit(0))


def one_unit(units: Column) -> Column:
    """The unit of an array of units; an empty one, several and unknown ones are an error that names them."""
    distinct = F.array_distinct(units)
    told = F.concat(F.lit("no one known unit: "), F.array_join(F.coalesce(distinct, F.array().cast("array<string>")), ", ", "null"))
    fits = (F.size(distinct) == 1) & F.array_contains(F.array(*(F.lit(u) for u in C.UNITS)), F.get(distinct, F.lit(0)))
    return F.when(F.coalesce(fits, F.lit(False)), F.get(distinct, F.lit(0))).otherwise(F.raise_error(told))


def unit_scale(unit: Column) -> Column:
    """Microvolts of a unit; null for unknown units."""
    out = F.lit(None).cast("double")
    for name, scale in C.UNITS.items():
        out = F.when(unit == name, F.lit(scale)).otherwise(out)
    return out


def plot_rank(value: Column, kind: str) -> Column:
    """Place in the plot order of a kind, from 1; 0 for unknown values."""
    return F.array_position(F.array(*(F.lit(v) for v in C.PLOT_ORDER[kind])), value)
