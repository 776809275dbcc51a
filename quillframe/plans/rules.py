"""Rule tables: month tokens, header aliases and software signatures. They are parameters of plans, read once on the driver."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

# Month tokens in order of priority.
MONTH_TOKENS: tuple[tuple[str, int], ...] = (
    ("jan", 1), ("janv", 1), ("janvier", 1),
    ("fév", 2), ("fev", 2), ("févr", 2), ("fevr", 2), ("février", 2), ("fevrier", 2),
    ("mar", 3), ("mars", 3),
    ("avr", 4), ("avril", 4),
    ("mai", 5),
    ("jun", 6), ("juin", 6),
    ("jui", 7), ("juil", 7), ("juillet", 7),
    ("aoû", 8), ("aou", 8), ("août", 8), ("aout", 8),
    ("sep", 9), ("sept", 9), ("septembre", 9),
    ("oct", 10), ("octobre", 10),
    ("nov", 11), ("novembre", 11),
    ("déc", 12), ("dec", 12), ("décembre", 12), ("decembre", 12),
)

# What a rendered month column bears, January to December.
MONTH_LABELS: tuple[str, ...] = ("janv", "févr", "mars", "avr", "mai", "juin", "juil", "août", "sept", "oct", "nov", "déc")

# Header cells of each canonical column.
COLUMN_ALIASES: dict[str, tuple[str, ...]] = {
    "code_produit": ("ean", "code ean", "code produit", "cip"),
    "designation": ("désignation", "designation", "libellé", "libelle"),
    "quantity": ("qté", "qte", "quantité", "quantite"),
    "pa_cat": ("pa cat", "pa cat."),
    "pa_cat_net": ("pa cat net",),
    "pv_ttc": ("pv ttc",),
    "date": ("date", "date de vente"),
    "amount": ("montant",),
    "total": ("total",),
}

# Signatures of each software, in order of priority.
SIGNATURES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("etat_des_ventes", ("ETAT DES VENTES", "ÉTAT DES VENTES", "Etat des ventes")),
    ("lgpi", ("LGPI", "Logiciel LGPI")),
    ("winpharma", ("WINPHARMA", "Win Pharma")),
)

FIXED_COLUMNS = ("code_produit", "designation", "pa_cat", "pa_cat_net", "pv_ttc")
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".tif", ".tiff")


@dataclass(frozen=True)
class Rules:
    """The rule tables of a plan. Keys are compared stripped and lower-cased; earlier entries win."""

    months: tuple[tuple[str, int], ...] = MONTH_TOKENS
    aliases: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(COLUMN_ALIASES))
    signatures: tuple[tuple[str, tuple[str, ...]], ...] = SIGNATURES
    labels: tuple[str, ...] = MONTH_LABELS

    def alias_map(self) -> dict[str, str]:
        return {a.strip().lower(): canonical for canonical, names in self.aliases.items() for a in names}

    def month_map(self) -> dict[str, str]:
        return {t.strip().lower(): f"{m:02d}" for t, m in self.months}

    def label_token(self, month: int) -> str:
        """The token that a rendered month column bears."""
        return self.labels[month - 1]


DEFAULT = Rules()


def validate(rules: Rules) -> Rules:
    """Raises ValueError or TypeError if a table is not of its shape."""
    if not isinstance(rules.aliases, dict):
        raise TypeError("aliases must be an object")
    if not all(1 <= m <= 12 for _, m in rules.months):
        raise ValueError("months are numbered from 1 to 12")
    if not all(label == "" or (label, m) in rules.months for m, label in enumerate(rules.labels, 1)):
        raise ValueError("a month's label is one of its tokens")
    for name, own in rules.signatures:
        if not own:
            raise ValueError(f"{name} has no signature")
    return rules


def month_labels(months: dict[str, int]) -> tuple[str, ...]:
    """A label for each month of a token table without labels: of its tokens of up to four letters, if there are any, the last of the longest; empty for a month without tokens."""
    out = []
    for month in range(1, 13):
        own = sorted((t for t, m in months.items() if m == month), key=lambda t: (len(t), t))
        out.append(next((t for t in reversed(own) if len(t) <= 4), own[-1] if own else ""))
    return tuple(out)


def load(spark: SparkSession, folder: str, names: tuple[str, str, str] = ("months.json", "aliases.json", "signatures.json")) -> Rules:
    """Rules from three JSON files of a folder, read once on the driver; see from_json()."""
    return from_json(*(json.loads(spark.read.text(f"{folder}/{n}", wholetext=True).first().value) for n in names))


def from_json(months: object, aliases: object, signatures: object) -> Rules:
    """Rules of parsed JSON: {token: number}, {alias: column} and [{id, signatures}]."""
    for what, x in (("months", months), ("aliases", aliases)):
        if not isinstance(x, dict):
            raise TypeError(f"{what} must be an object")
    if not isinstance(signatures, list):
        raise TypeError("signatures must be a list")
    by: dict[str, tuple[str, ...]] = {}
    for alias, column in aliases.items():
        by[column] = (*by.get(column, ()), alias)
    numbered = {t: int(m) for t, m in months.items()}
    return validate(Rules(tuple(numbered.items()), by, tuple((s["id"], tuple(s["signatures"])) for s in signatures), month_labels(numbered)))
