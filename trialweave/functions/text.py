"""Text functions: stripping, file-safe names, clock times and timeline lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space with the four separators that Java's class leaves out.
SPACE = r"(?U)[\s\x1c-\x1f]"
#: Characters that file names may not have.
FORBIDDEN = r"[<>:\"/\\|?*\x00-\x1f]"
STEM_LENGTH = 40
#: Width of speaker and event in a rendered timeline.
SPEAKER_WIDTH, EVENT_WIDTH = 5, 12


def strip(text: Column) -> Column:
    """``text`` without white space, of any script, at its ends."""
    return F.regexp_replace(text, rf"{SPACE}+\z|\A{SPACE}+", "")


def stem_name(text: Column) -> Column:
    """The part of a prompt's file-safe name that comes from up to 40 characters of its text; it may be empty.

    The order matters: a dot or underscore that truncation exposes at the end goes too.
    """
    joined = F.regexp_replace(strip(text), f"{SPACE}+", "_")
    short = F.substring(F.regexp_replace(joined, FORBIDDEN, ""), 1, STEM_LENGTH)
    return F.btrim(short, F.lit("._"))


def numbered_stem(name: Column, index: Column) -> Column:
    """A prompt's file-safe name: its number and its ``stem_name``."""
    number = F.format_string("text_%03d", index.cast("long"))
    return F.when(name != "", F.concat(number, F.lit("_"), name)).otherwise(number)


def prompt_stem(text: Column, index: Column) -> Column:
    """A file-safe name for a prompt: its number and up to 40 characters of its text."""
    return numbered_stem(stem_name(text), index)


def piece_text(piece: Column) -> Column:
    """A tokenizer's piece with its word mark, U+2581, as a space."""
    return F.replace(piece, F.lit("▁"), F.lit(" "))


def clock(seconds: Column) -> Column:
    """MM:SS.mmm; minutes are taken before rounding, so 59.9996 shows as 00:60.000. Null shows as dashes."""
    minutes = F.floor(seconds / 60)
    shown = F.format_string("%02d:%06.3f", minutes, F.bround(seconds - minutes * 60, 3))
    return F.when(seconds.isNull(), "--:--.---").otherwise(shown)


def padded(text: Column, width: int) -> Column:
    """``text`` filled up with spaces on the right, never cut."""
    return F.when(F.length(text) < width, F.rpad(text, width, " ")).otherwise(text)


def timeline_line(time: Column, speaker: Column, event: Column, text: Column) -> Column:
    """One line of a rendered timeline."""
    tail = F.when(text != "", F.concat(F.lit(" "), text)).otherwise("")
    return F.concat(F.lit("["), time, F.lit("] "), padded(speaker, SPEAKER_WIDTH), F.lit(" "), padded(event, EVENT_WIDTH), tail)


def or_default(text: Column, default: Column) -> Column:
    """``text``, or ``default`` where it is null or empty."""
    return F.coalesce(F.nullif(text, F.lit("")), default)


def stem_of(path: Column) -> Column:
    """The last part of a path without its suffix."""
    name = F.regexp_extract(path, r"([^/]*)/*\z", 1)
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]*\z", "")


def without_suffix(path: Column) -> Column:
    """A path without its suffix: the key that joins a waveform to its text."""
    return F.regexp_replace(path, r"(?<=[^./])\.[^./]*\z", "")
