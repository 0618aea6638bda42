"""Unit tables: codes and names of lithologies and stratigraphic units as small relations and mappings."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lithology classes of the national voxel model.
LITHOLOGY = {"anthropogenic": 0, "organic": 1, "clay": 2, "loam": 3, "fine_sand": 5, "medium_sand": 6, "coarse_sand": 7, "gravel": 8, "shells": 9}

#: Stratigraphic units of the national voxel model, by group.
ANTHROPOGENIC_UNITS = {"AAOP": 1000, "AAES": 1005}
HOLOCENE_UNITS = {
    "NIGR": 1010, "NINB": 1045, "NASC": 1020, "ONAWA": 1030, "NAZA": 1040, "NAWAZU": 1048, "NAWAAL": 1049, "NAWA": 1050,
    "BHEC": 1060, "OEC": 1070, "NAWOBE": 1080, "KK1": 1085, "NIFL": 1089, "NIHO": 1090, "NAZA2": 1095, "NAWO": 1100,
    "NWNZ": 1110, "NAWOVE": 1120, "KK2": 1125, "NIBA": 1130, "NA": 2000, "EC": 2010, "NI": 2020, "KK": 2030,
}
OLDER_UNITS = {
    "BXKO": 3000, "BXSI": 3010, "BXSI1": 3011, "BXWI": 3020, "BXSI2": 3012, "BXWIKO": 3025, "BXWISIKO": 3030, "BXDE": 3040,
    "BXDEKO": 3045, "BXSC": 3050, "BXLM": 3060, "BXBS": 3090, "BX": 3100, "KRWY": 4000, "KRBXDE": 4010, "KRZU": 4020,
    "KROE": 4030, "KRTW": 4040, "KR": 4050, "BEOM": 4055, "BEWY": 4060, "BERO": 4070, "BE": 4080, "KW1": 4085, "KW": 4090,
    "WB": 4100, "EE": 4110, "EEWB": 4120, "DR": 5000, "DRGI": 5010, "GE": 5020, "DN": 5030, "URTY": 5040, "PE": 5050,
    "UR": 5060, "ST": 5070, "AP": 5080, "SY": 5090, "PZ": 5100, "WA": 5110, "PZWA": 5120, "MS": 5130, "KI": 5140,
    "OO": 5150, "IE": 5160, "VI": 5170, "BR": 5180, "VE": 5185, "RUBO": 5190, "RU": 5200, "TOZEWA": 5210, "TOGO": 5220,
    "TO": 5230, "DOAS": 5240, "DOIE": 5250, "DO": 5260, "LA": 5270, "HT": 5280, "HO": 5290, "MT": 5300, "GU": 5310,
    "VA": 5320, "AK": 5330,
}
CHANNEL_BELT_UNITS = {
    "AEC": 6000, "ABEOM": 6005, "ANAWA": 6010, "ANAWO": 6020, "BEC": 6100, "BNAWA": 6110, "BNAWO": 6120, "CEC": 6200,
    "CNAWA": 6210, "CNAWO": 6220, "DEC": 6300, "DNAWA": 6310, "DNAWO": 6320, "EEC": 6400, "ENAWA": 6410, "ENAWO": 6420,
}


class UnitTable:
    """Names and codes of one group of units."""

    def __init__(self, units: dict[str, int]):
        self.units = dict(units)

    def select_units(self, names: str | Iterable[str]) -> dict[str, int]:
        names = [names] if isinstance(names, str) else names
        return {n: self.units[n] for n in names}

    def select_values(self, codes: int | Iterable[int]) -> dict[str, int]:
        wanted = {codes} if isinstance(codes, int) else set(codes)
        return {n: c for n, c in self.units.items() if c in wanted}

    def to_dict(self, key: str = "code") -> dict:
        return {c: n for n, c in self.units.items()} if key == "code" else dict(self.units)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.units.items()), "unit string, code int")

    def name_of(self, code: Column) -> Column:
        """The name of a code by a constant map: no join for a table this small."""
        return F.element_at(F.create_map(*[F.lit(v) for n, c in self.units.items() for v in (c, n)]), code.cast("int"))


class UnitGroups:
    """Several unit tables looked up together, as in a stratigraphy of groups."""

    def __init__(self, **groups: UnitTable):
        self.groups = groups

    def select_units(self, names: str | Iterable[str]) -> dict[str, int]:
        names = [names] if isinstance(names, str) else list(names)
        return {n: t.units[n] for n in names for t in self.groups.values() if n in t.units}

    def select_values(self, codes: int | Iterable[int]) -> dict[str, int]:
        return {n: c for t in self.groups.values() for n, c in t.select_values(codes).items()}

    def to_dict(self, key: str = "code") -> dict:
        return {k: v for t in self.groups.values() for k, v in t.to_dict(key).items()}

    def name_of(self, code: Column) -> Column:
        """The name of a code of any group."""
        return UnitTable(self.to_dict("unit")).name_of(code)


MAX_UNITS = 10_000


def read_units(df: DataFrame, name: str = "unit", code: str = "code") -> UnitTable:
    """A unit table from a small relation of names and codes (tens to hundreds of rows)."""
    rows = df.select(name, code).orderBy(code).limit(MAX_UNITS + 1).collect()
    if len(rows) > MAX_UNITS:
        raise ValueError(f"more than {MAX_UNITS} units: join such a table in place of a mapping")
    return UnitTable({r[name]: r[code] for r in rows})


lithology = UnitTable(LITHOLOGY)
stratigraphy = UnitGroups(
    holocene=UnitTable(HOLOCENE_UNITS),
    channel=UnitTable(CHANNEL_BELT_UNITS),
    older=UnitTable(OLDER_UNITS),
    anthropogenic=UnitTable(ANTHROPOGENIC_UNITS),
)
