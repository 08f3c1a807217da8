from datetime import datetime

import pytest
from pyspark.sql import functions as F

from voltaloom import constants as C
from voltaloom.functions import names as N

CHANNELS = ["LMot", "left Aud", "RIGHT vis", "L Hip", "Left Mot Vis", "left right Bar", "channel_9", "Intan 22", "nothing", "x 99", "Aud", ""]


def scalar(name, **how):
    try:
        return N.channel_abbreviation(name, **how)
    except (ValueError, KeyError):
        return None


def test_channel_names_in_columns_and_one_by_one(spark):
    df = spark.createDataFrame([(c,) for c in [*CHANNELS, None]], "name string")
    for how in ({}, {"from_number": True}, {"strict": False}, {"from_number": True, "strict": False}):
        got = {r.name: r.k for r in df.select("name", N.channel_abbreviation_col(F.col("name"), **how).alias("k")).collect()}
        assert got == {**{c: scalar(c, **how) for c in CHANNELS}, None: None}, how
    assert scalar("left Aud") == "LAud" and scalar("left right Bar") is None and scalar("left right Bar", strict=False) == "RBar"
    assert scalar("left right Bar 9", from_number=True) == "LAud"


def test_the_longest_alias_decides(spark):
    aliases = {"WT": ["WT", "wild"], "KO": ["wildless", "KO"]}
    assert N.alias_key("a wildless mouse", aliases, strict=False) == "KO" and N.alias_key("wild", aliases) == "WT"
    with pytest.raises(ValueError, match="ambiguous"):
        N.alias_key("a wildless mouse", aliases)
    with pytest.raises(ValueError, match="alias"):
        N.alias_key("none", aliases)
    got = spark.createDataFrame([("a wildless mouse",), ("wild",), ("none",)], "t string").select(N.alias_col(F.col("t"), aliases)).collect()
    assert [r[0] for r in got] == ["KO", "WT", None]


def test_days_in_each_mode():
    day = datetime(2023, 12, 13)
    assert N.day_of("A10 KO 12-13-2023") == day and N.day_of("Dec-13 2023", mode="window") == day and N.day_of("Dec 13 2023", mode="full") == day
    assert N.day_of("mouse Dec 13 2023 run", mode="all") == day and N.day_of("x_20231213_y", patterns=[(r"\d{8}", "%Y%m%d")]) == day
    assert N.day_of("A10_KO_12-13-2023", sep="_") == day
    for text, how in (("no day", {}), ("12-13-1979", {}), ("", {"mode": "all"})):
        with pytest.raises(ValueError, match="date"):
            N.day_of(text, **how)
    with pytest.raises(ValueError, match="mode"):
        N.day_of("12-13-2023", mode="odd")


def test_animals_and_sessions():
    assert N.animal_id("WT_A5_x", ["B1", "A5", "WT"]) == "A5"
    for rule in (r"Z\d", ["B1"]):
        with pytest.raises(ValueError, match="finds nothing"):
            N.animal_id("WT_A5_x", rule)
    assert N.session_of("/d/A5 WT/12-13-2023", "nest")["animalday"] == "A5 WT Dec-13-2023"
    assert N.session_of("/d/A5 WT x", "noday")["day"] == N.DEFAULT_DAY.strftime("%b-%d-%Y") and set(C.GENOTYPES) == {"WT", "KO"}
