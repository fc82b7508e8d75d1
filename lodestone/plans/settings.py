"""Settings: two layered TOML files into one frozen object; the internal file wins over the user's."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields, replace

#: Datatypes whose claims are exported unless a file says otherwise, and properties that hold dates. Fixed values.
DATATYPES = ("wikibase-item", "time", "quantity", "globe-coordinate", "monolingualtext", "string")
DATE_PROPERTIES = ("P569", "P570", "P571", "P580", "P582")


@dataclass(frozen=True)
class Settings:
    """What decides which rows exist; tags are in bit order."""

    languages: tuple[str, ...] = ("en", "de", "es")
    concepts: tuple[str, ...] = ()
    text_index: bool = True
    globe_index: bool = True
    date_index: bool = True
    astro_index: bool = True
    all_globe: bool = False
    all_dates: bool = False
    all_astro: bool = False
    astro_classes: tuple[str, ...] = ()
    most_magnitude: float = 6.5
    exported_datatypes: tuple[str, ...] = DATATYPES
    case_sensitive: bool = False
    text_tags: tuple[str, ...] = ()
    date_tags: tuple[str, ...] = ()
    globe_tags: tuple[str, ...] = ()
    astro_tags: tuple[str, ...] = ()
    class_property: str = "P31"
    globe_property: str = "P625"
    date_properties: tuple[str, ...] = DATE_PROPERTIES
    magnitude_property: str = "P1457"
    ascension_property: str = "P6257"
    declination_property: str = "P6258"

    def all_tags(self) -> list[str]:
        """The union of the four vocabularies, sorted."""
        return sorted({*self.text_tags, *self.date_tags, *self.globe_tags, *self.astro_tags})


def load_settings(*paths: str) -> Settings:
    """Settings of TOML files, later files over earlier ones; tables in a file are flattened, keys that no field has are an error."""
    found: dict = {}

    def take(table: dict) -> None:
        for k, v in table.items():
            if isinstance(v, dict):
                take(v)
            else:
                found[k] = tuple(v) if isinstance(v, list) else v

    for p in paths:
        with open(p, "rb") as f:
            take(tomllib.load(f))
    if unknown := set(found) - {f.name for f in fields(Settings)}:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return replace(Settings(), **found)
