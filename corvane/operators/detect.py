"""A small language detector for routing, from each language's short common
words.  Any other can take its place: only code and score are used."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.text import words

#: fixed values: common short words of each language
COMMON = (
    ("eng", "the of and to in is that it was for on are as with his they be at this have from or by not but what all were we when your can said there"),
    ("fra", "le la les de des et en un une du que qui dans est pour pas sur au avec par ce il elle ne se son sa aux plus"),
    ("deu", "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat"),
    ("spa", "el la los las de y en que un una por con para del se no al es lo su como más pero sus le ya o este"),
)


def _among(known: list[str]):
    return lambda w: w.isin(*known)


def detect(text: Column) -> Column:
    """code and score: the language with most of its common words in the text,
    and its share of all that were found; `und` where none was."""
    own = words(F.lower(F.coalesce(text, F.lit(""))))
    counts = [F.size(F.filter(own, _among(known.split()))) for _, known in COMMON]
    total, best = sum(counts[1:], counts[0]), F.greatest(*counts)
    code = F.coalesce(*[F.when((n == best) & (best > 0), F.lit(name)) for (name, _), n in zip(COMMON, counts, strict=True)], F.lit("und"))
    return F.struct(code.alias("code"), F.when(total > 0, best / total).otherwise(0.0).alias("score"))
