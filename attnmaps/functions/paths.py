"""Column functions on image paths and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Synset numbers below this are animals.
ANIMAL_LIMIT = 2666196


def image_key(path) -> Column:
    """Last two parts of a path."""
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), "/")


def category(key) -> Column:
    """First part of an image key."""
    return F.split_part(key, F.lit("/"), F.lit(1))


def flat_name(key) -> Column:
    """Key with underscores for slashes."""
    return F.replace(key, F.lit("/"), F.lit("_"))


def unflat_name(name) -> Column:
    """The first underscore becomes a slash again."""
    return F.regexp_replace(name, "^([^_]*)_", "$1/")


def synset(path) -> Column:
    """Third part of a path if it is a synset name, else null."""
    part = F.get(F.split(path, "/"), 2)
    return F.when(part.rlike("^n[0-9]+$"), part)


def synset_number(path) -> Column:
    return F.substring(synset(path), 2, 100).cast("long")


def is_animal(path) -> Column:
    return synset_number(path) < ANIMAL_LIMIT


def frame_of(key) -> Column:
    """Number between the last underscore and the dot after it."""
    return F.regexp_extract(key, r"_([0-9]+)\.[^_]*$", 1).cast("int")


def zoom_of(key) -> Column:
    return frame_of(key) % 3


def sequence_of(key) -> Column:
    """Everything before the last underscore."""
    return F.regexp_extract(key, "^(.*)_[^_]*$", 1)


def scale_targets(frame: Column) -> Column:
    """Array of (target, diff): the three zooms of a frame's triple."""
    zoom = frame % 3
    return F.transform(F.sequence(-zoom, 2 - zoom), lambda d: F.struct((frame + d).alias("target"), d.alias("diff")))


def rotation_targets(frame: Column, frames: int = 24) -> Column:
    """Array of (target, diff): the same zoom in eight directions around."""
    return F.transform(F.sequence(F.lit(-3), F.lit(4)), lambda d: F.struct(F.pmod(frame + 3 * d + frames, F.lit(frames)).alias("target"), d.alias("diff")))


def without_extension(key) -> Column:
    return F.split_part(key, F.lit("."), F.lit(1))


def hashed_number(text: Column) -> Column:
    """A number below 2 ** 32 from a text's MD5, the same in every engine."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")
