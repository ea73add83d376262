"""Text expressions: names, codes, numbers and dates written as text."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping, Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame, functions as F

from brisa.constants import GENERIC_SET_WORDS


@lru_cache(maxsize=1)
def _latin_table() -> tuple[str, str]:
    """Accented Latin letters and their plain letter, by Unicode decomposition."""
    source, target = [], []
    for code in [*range(0xA0, 0x250), *range(0x1E00, 0x1F00)]:
        plain = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            source.append(chr(code))
            target.append(plain)
    return "".join(source), "".join(target)


def strip_accents(c: Column) -> Column:
    """Plain ASCII text; letters without a plain form are dropped."""
    source, target = _latin_table()
    return F.regexp_replace(F.translate(c, source, target), r"[^\x00-\x7F]", "")


def collapse_spaces(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")


def title_case(c: Column) -> Column:
    """Upper-case the first letter of every run of letters."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(
        F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1_000_000)))), "")


def standardise(c: Column, *, extra_spaces: bool = True, lower: bool = False,
                accents: bool = False, punctuation: bool = False, title: bool = False,
                replacements: Mapping[str, str] | None = None) -> Column:
    """Spellings of the same value to one form; exact replacements come last."""
    if extra_spaces:
        c = collapse_spaces(c)
    if lower:
        c = F.lower(c)
    if accents:
        c = strip_accents(c)
    if punctuation:
        c = F.regexp_replace(c, r"(?U)[^\w\s]", "")
    if title:
        c = title_case(c)
    if replacements:
        c = F.coalesce(map_code(c, replacements), c)
    return c


def name_key(c: Column) -> Column:
    """Key to compare spellings of a name."""
    return collapse_spaces(standardise(c, lower=True, accents=True, punctuation=True))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(strip_accents(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def clean_text(c: Column, empties: Sequence[str] = ("",)) -> Column:
    trimmed = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return F.when(~trimmed.isin(*empties), trimmed)


def clean_texts(df: DataFrame, columns: Sequence[str], empties: Sequence[str] = ("",)) -> DataFrame:
    return df.withColumns({c: clean_text(F.col(c), empties) for c in columns})


def to_number(c: Column, brazilian: bool = True) -> Column:
    """Number from text such as 'R$ 1.234,56'; what is not a number gives null."""
    text = F.regexp_replace(c, r"[R$%\s\u00A0]", "")
    if brazilian:
        text = F.regexp_replace(F.regexp_replace(text, r"\.", ""), ",", ".")
    shape = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
    return F.when(text.rlike(shape), text.try_cast("double"))


DAY_FIRST = ("dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "dd/MM/yyyy", "dd-MM-yyyy", "dd.MM.yyyy")
YEAR_FIRST = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")
MONTH_FIRST = ("MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm", "MM/dd/yyyy", "MM-dd-yyyy")


def to_date_time(c: Column, fmt: str | None = None, day_first: bool = True) -> Column:
    """Wall-clock time from text, with a format or day first; bad text gives null."""
    formats = [fmt] if fmt else [*(DAY_FIRST if day_first else MONTH_FIRST), *YEAR_FIRST]
    text = F.trim(c)
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in formats])


def first_of_list(c: Column, separator: str = ",") -> Column:
    return F.trim(F.element_at(F.split(c, separator), 1))


def split_place(c: Column) -> tuple[Column, Column]:
    """('Name', 'UF') of 'Name - UF', cut at the last ' - '."""
    last = F.regexp_extract(c, r"^.* - (.*)$", 1)
    has = c.contains(" - ")
    name = F.when(has, F.regexp_replace(c, r"^(.*) - .*$", "$1")).otherwise(c)
    return F.trim(name), F.when(has, F.trim(last))


def base_code(c: Column) -> Column:
    """Code without the version after its last dot."""
    return F.regexp_replace(c, r"\.[^.]*$", "")


def map_code(c: Column, table: Mapping[str, str], default: str | None = None) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), c)
    return F.coalesce(found, F.lit(default)) if default is not None else found


def natural_key(unit_id: Column, name: Column, state: Column) -> Column:
    return F.coalesce(unit_id, F.concat(F.lit("PQU|"), name, F.lit("|"), state))


def core_name(normalised: Column) -> Column:
    """Name of a set of plants without voltage and generic words."""
    no_voltage = F.regexp_replace(normalised, r"\b\d+\s*kv\b", " ")
    words = F.filter(F.split(no_voltage, r"\s+"),
                     lambda w: (w != "") & ~w.isin(*GENERIC_SET_WORDS))
    return F.array_join(words, " ")


def clean_column_names(names: Sequence[str], *, lower: bool = True, accents: bool = True,
                       snake: bool = True, digit_prefix: str = "col_") -> list[str]:
    """Column names safe for SQL; a repeated name gets _2, _3 and so on."""
    out, seen = [], {}
    for raw in names:
        name = str(raw).strip()
        if accents:
            name = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode()
        name = name.lower() if lower else name
        if snake:
            name = re.sub("_+", "_", re.sub(r"\W+", "_", name)).strip("_")
        name = digit_prefix + name if name[:1].isdigit() else name or "coluna_sem_nome"
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return out


def rename_clean(df: DataFrame, **options) -> DataFrame:
    return df.toDF(*clean_column_names(df.columns, **options))


def rename_and_drop(df: DataFrame, renames: Mapping[str, str], drops: Sequence[str] = ()) -> DataFrame:
    return df.drop(*drops).withColumnsRenamed(dict(renames))


def detect_types(df: DataFrame, columns: Sequence[str] | None = None, share: float = 0.8,
                 brazilian: bool = True, day_first: bool = True) -> DataFrame:
    """Turn text columns into number, else date, when at least `share` of the
    non-null values convert. One pass decides all columns."""
    columns = list(columns or [n for n, t in df.dtypes if t == "string"])
    if not columns:
        return df
    counts = []
    for c in columns:
        counts += [F.count(c).alias(f"n_{c}"),
                   F.count(to_number(F.col(c), brazilian)).alias(f"num_{c}"),
                   F.count(to_date_time(F.col(c), day_first=day_first)).alias(f"dat_{c}")]
    row = df.agg(*counts).first()
    changes = {}
    for c in columns:
        if row[f"num_{c}"] >= share * row[f"n_{c}"]:
            changes[c] = to_number(F.col(c), brazilian)
        elif row[f"dat_{c}"] >= share * row[f"n_{c}"]:
            changes[c] = to_date_time(F.col(c), day_first=day_first)
    return df.withColumns(changes) if changes else df


def convert_types(df: DataFrame, numbers: Sequence[str] = (), dates: Sequence[str] = (), *,
                  date_format: str | None = None, brazilian: bool = True,
                  day_first: bool = True) -> DataFrame:
    changes = {c: to_number(F.col(c), brazilian) for c in numbers}
    changes |= {c: to_date_time(F.col(c), date_format, day_first) for c in dates}
    return df.withColumns(changes) if changes else df
