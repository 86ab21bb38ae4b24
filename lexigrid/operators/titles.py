"""Exact comparison keys of titles, for text beyond what the JVM's rules fold."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lexigrid.functions import rules

# Legal forms at the end of a company's name.
COMPANY = "inc incorporated ltd limited llc llp plc corp corporation co company gmbh ag sa srl bv nv oy ab pty".split()
_OTHER = re.compile(r"[\W_]+")
_SUFFIX = re.compile(rf"[\s,]+(?:{'|'.join(COMPANY)})\.?$")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def fold_key(title: str | None) -> str | None:
    """NFKC, lower case, runs of other than letters and numbers to a blank; null stays null."""
    return None if title is None else _OTHER.sub(" ", unicodedata.normalize("NFKC", title).lower()).strip()


def fold_company(title: str | None) -> str:
    """NFKC, lower case, underscores to blanks, legal forms and outer punctuation removed; null is empty."""
    text = " ".join(unicodedata.normalize("NFKC", title or "").replace("_", " ").split()).lower()
    while (shorter := _SUFFIX.sub("", text).strip()) != text:
        text = shorter
    return " ".join(_EDGES.sub("", text).split())


@F.pandas_udf(StringType())
def folded_key(titles: pd.Series) -> pd.Series:
    return titles.map(lambda t: fold_key(t if isinstance(t, str) else None))


@F.pandas_udf(StringType())
def company_key(titles: pd.Series) -> pd.Series:
    return titles.map(lambda t: fold_company(t if isinstance(t, str) else None))


def key(text: Column) -> Column:
    """Comparison key of a title or passage: NFKC, lower case, runs of other than letters and numbers to a blank.

    Texts of ASCII alone are folded by the JVM; only others go to Python.
    """
    return F.coalesce(folded_key(F.when(~text.rlike(r"\A[\x00-\x7f]*\z"), text)), rules.key(text))
