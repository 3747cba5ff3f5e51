"""Call envelopes: a version byte, then the JSON of arguments."""

from pyspark.sql import Column
from pyspark.sql import functions as F

VERSION = "4A"


def to_envelope(text: Column) -> Column:
    return F.concat(F.unhex(F.lit(VERSION)), F.encode(text, "UTF-8"))


def from_envelope(payload: Column) -> Column:
    """The JSON text; null for payloads of another version."""
    return F.when(F.hex(F.substring(payload, 1, 1)) == VERSION, F.decode(F.substring(payload, 2, 2**31 - 1), "UTF-8"))
