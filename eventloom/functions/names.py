"""Column functions of names and paths: copy suffixes, folders, event names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Suffixes that file managers put before the extension of a copy, in order.
COPY_SUFFIXES = (r"-Kopiuj(?:\s*\(\d+\))?$", r"(?i)\s*-\s*Copy(?:\s*\(\d+\))?$", r"\s*\(\d+\)$")
#: A name with more images, or more videos, than this is marked rich.
RICH = 10


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent_name(path: Column) -> Column:
    """Name of the folder that holds ``path``; null at the top."""
    return F.try_element_at(F.split(path, "/"), F.lit(-2))


def strip_copy_suffix(name: Column) -> Column:
    """``name`` without one copy suffix before its extension; the first pattern that fits is taken off, once.

    A name whose only dot leads it has no extension.
    """
    extension = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    stem = F.substring(name, F.lit(1), F.char_length(name) - F.char_length(extension))
    stripped = F.when(F.lit(False), stem)
    for pattern in COPY_SUFFIXES:
        stripped = stripped.when(F.regexp_like(stem, F.lit(pattern)), F.regexp_replace(stem, pattern, ""))
    return F.concat(stripped.otherwise(stem), extension)


def is_year_folder(path: Column) -> Column:
    return F.coalesce(F.regexp_like(basename(path), F.lit(r"^(19|20)\d{2}$")), F.lit(False))


def is_event_folder(path: Column) -> Column:
    """Directly inside a year folder."""
    return F.coalesce(F.regexp_like(parent_name(path), F.lit(r"^(19|20)\d{2}$")), F.lit(False))


def is_sel_folder(path: Column) -> Column:
    return F.coalesce(basename(path) == "sel", F.lit(False))


def is_sub_event_folder(path: Column) -> Column:
    """No folder counts as one yet."""
    return F.lit(False)


def folder_type(path: Column) -> Column:
    """year, sel, event, sub_event or unknown, in this order of precedence."""
    return (
        F.when(is_year_folder(path), "year")
        .when(is_sel_folder(path), "sel")
        .when(is_event_folder(path), "event")
        .when(is_sub_event_folder(path), "sub_event")
        .otherwise("unknown")
    )


def library_is_valid(folders: DataFrame, path: str = "path") -> DataFrame:
    """One row: whether no folder is of unknown type (true without folders)."""
    return folders.agg((~F.coalesce(F.bool_or(folder_type(F.col(path)) == "unknown"), F.lit(False))).alias("is_valid"))


def relative_path(path: Column, library: Column) -> Column:
    """``path`` below ``library``; trailing slashes of the library don't matter."""
    root = F.concat(F.regexp_replace(library, r"[/\\]+$", ""), F.lit("/"))
    return F.when(F.startswith(path, root), F.substring(path, F.char_length(root) + 1, F.char_length(path))).otherwise(path)


def parse_flag(text: Column) -> Column:
    """Exactly ``True`` or ``False``; anything else raises."""
    return F.when(text == "True", True).when(text == "False", False).otherwise(F.raise_error(F.concat(F.lit("not a flag: "), F.coalesce(text, F.lit("null")))).cast("boolean"))


def event_name(date: Column, images: Column, videos: Column, key: Column) -> Column:
    """``[YYYY_MM_DD]_HHMMSS_IC_n_VC_m_``, then ``_rich`` for many files.

    Without a date the name is ``[NaT_]_`` and two groups of six digits drawn from ``key``.
    """
    known = F.date_format(date, "'['yyyy_MM_dd']_'HHmmss")
    digits = lambda seed: F.lpad(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_000)).cast("string"), 6, "0")
    unknown = F.concat(F.lit("[NaT_]_"), digits(1), F.lit("_"), digits(2))
    rich = F.when((images > RICH) | (videos > RICH), "_rich").otherwise("")
    return F.concat(F.coalesce(known, unknown), F.lit("_IC_"), images.cast("string"), F.lit("_VC_"), videos.cast("string"), F.lit("_"), rich)


def new_target(name: Column) -> Column:
    return F.concat(F.lit("new/"), name)


def existing_target(path: Column) -> Column:
    return F.concat(F.lit("existing/"), basename(path))


def duplicate_target(path: Column) -> Column:
    return F.concat(F.lit("duplicated/"), basename(path))


def in_year_folder(name: Column) -> Column:
    """Begins with four digits (a looser test than is_year_folder)."""
    return F.regexp_like(name, F.lit(r"^\d{4}"))


def catalogue_entry(folder: Column) -> Column:
    """An event folder ``[YYYY_MM_DD]_name`` as ``YYYY-MM-DD;name``.

    Null unless ``]_`` occurs exactly once and a date stands before it; a missing name is
    ``unlabelled``; underscores of the name become spaces.
    """
    parts = F.split(folder, r"\]_", -1)
    date = F.replace(F.substring(parts[0], 2, 1 << 30), F.lit("_"), F.lit("-"))
    name = F.when(parts[1] == "", "unlabelled").otherwise(F.replace(parts[1], F.lit("_"), F.lit(" ")))
    return F.when((F.size(parts) == 2) & (date != ""), F.concat_ws(";", date, name))
