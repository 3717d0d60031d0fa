"""Column functions on symbols, headers and numbers.

Texts are one character a byte: decode raw bytes with ``bytes_text`` first, so that lengths,
positions and reversal count bytes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Complement pairs of the IUPAC nucleotide letters; U becomes A; all else stays. Fixed values.
COMPLEMENT_FROM, COMPLEMENT_TO = "ACGTURYKMBVDHacgturykmbvdh", "TGCAAYRMKVBHDtgcaayrmkvbhd"
#: Letters of the alphabets; fixed values.
IUPAC = "ACGTURYSWKMBDHVNacgturyswkmbdhvn"
PROTEIN = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz*-"
ALPHABETS = {"dna": "ACGTNacgtn", "rna": "ACGUNacgun", "nucleotide": IUPAC + "-", "protein": PROTEIN}


def bytes_text(raw: Column) -> Column:
    """Bytes (or the UTF-8 bytes of a string) as a string of one character each."""
    return F.decode(raw.cast("binary"), "ISO-8859-1")


def text_bytes(text: Column) -> Column:
    return F.encode(text, "ISO-8859-1")


def symbols(text: Column) -> Column:
    """The symbols of a line: its bytes above the space."""
    return F.regexp_replace(text, r"[\x00-\x20]", "")


def identifier(header: Column) -> Column:
    """The identifier of a header without its mark: up to a space, tab, CR or LF."""
    return F.regexp_extract(header, r"^[^ \t\r\n]*", 0)


def description(header: Column) -> Column:
    """What follows the identifier, without spaces, tabs and CRs around it."""
    return F.regexp_replace(F.regexp_replace(header, r"^[^ \t\r\n]*", ""), r"^[ \t\r]+|[ \t\r]+$", "")


def complement(seq: Column) -> Column:
    return F.translate(seq, COMPLEMENT_FROM, COMPLEMENT_TO)


def orient(seq: Column, reverse: Column, complemented: Column) -> Column:
    """Reversed, complemented, both or neither."""
    turned = F.when(reverse, F.reverse(seq)).otherwise(seq)
    return F.when(complemented, complement(turned)).otherwise(turned)


def wrap(seq: Column, width: int = 60) -> Column:
    """A sequence in lines of ``width`` symbols, the last without a line end."""
    return F.regexp_replace(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), "\n$", "")


def fixed(n: Column, d: Column, digits: int = 2) -> Column:
    """n / d with ``digits`` decimals, half up, by whole numbers; 'n/a' if d is 0; no '-0.00'."""
    scale = 10**digits
    size = F.abs(n.cast("decimal(25,0)"))
    twice = size * (2 * scale) + d
    up = F.when(d != 0, (twice - twice % (d * 2)) / (d * 2)).cast("long")
    text = F.concat(F.floor(up / scale).cast("string"), F.lit("."), F.lpad((up % scale).cast("string"), digits, "0"))
    return F.when(d == 0, "n/a").otherwise(F.concat(F.when((n < 0) & (up > 0), "-").otherwise(""), text))


def is_nucleotide(iupac: Column, total: Column) -> Column:
    """Over nine tenths of the symbols are IUPAC letters; nothing is nucleotide too."""
    return (total == 0) | (iupac * 10 > total * 9)


def count_of(seq: Column, letters: str) -> Column:
    """How many characters of ``seq`` are among ``letters``."""
    return (F.length(seq) - F.length(F.translate(seq, letters, ""))).cast("long")
