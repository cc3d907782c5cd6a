"""Identifier expressions: type detection, normalisation, placeholders, tolerant parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Id types and their patterns, in the order they are tried.
ID_PATTERNS = [
    ("KEGG", r"^[a-z]{2,4}:[a-z0-9]+\z"),
    ("ENSEMBL", r"(?i)^ens[a-z]+\d{6,15}\z"),
    ("UNIPROT", r"^[A-NP-Q][0-9][A-Z0-9]{3}[0-9]\z"),
    ("REFSEQ", r"^N[MRP]_\d+\z"),
    ("ENTREZID", r"^\d+\z"),
    ("SYMBOL", r"^[A-Z][a-zA-Z0-9]{1,15}\z"),
]
UNKNOWN = "unknown"

# Target id type of each set database.
DATABASE_ID_TYPE = {"kegg": "ENTREZID", "go": "SYMBOL", "reactome": "SYMBOL", "msigdb": "SYMBOL"}

# NCBI taxon of each supported species code.
SPECIES_TAXON = {
    "hsa": 9606,
    "mmu": 10090,
    "rno": 10116,
    "dre": 7955,
    "dme": 7227,
    "cel": 6239,
    "sce": 559292,
    "ath": 3702,
    "eco": 562,
    "bta": 9913,
    "gga": 9031,
}

# Species names and stable-id prefixes used by Reactome files.
REACTOME_SPECIES = {
    "hsa": ("Homo sapiens", "R-HSA"),
    "mmu": ("Mus musculus", "R-MMU"),
    "rno": ("Rattus norvegicus", "R-RNO"),
    "dre": ("Danio rerio", "R-DRE"),
    "cel": ("Caenorhabditis elegans", "R-CEL"),
    "dme": ("Drosophila melanogaster", "R-DME"),
    "ath": ("Arabidopsis thaliana", "R-ATH"),
    "sce": ("Saccharomyces cerevisiae", "R-SCE"),
    "bta": ("Bos taurus", "R-BTA"),
    "gga": ("Gallus gallus", "R-GGA"),
}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(c) -> Column:
    """Trim spaces, tabs and line ends; blank becomes null."""
    c = _col(c)
    return F.nullif(F.regexp_replace(c, r"^\s+|\s+\z", ""), F.lit(""))


def detect_id_type(c) -> Column:
    """First pattern that fits the whole id; symbols with '-' or '.' stay unknown."""
    text = F.coalesce(clean(c), F.lit(""))
    branch = None
    for name, pattern in ID_PATTERNS:
        test = text.rlike(pattern)
        branch = F.when(test, name) if branch is None else branch.when(test, name)
    return branch.otherwise(UNKNOWN)


def strip_prefix(c, prefix: str) -> Column:
    c = _col(c)
    return F.when(c.startswith(prefix), F.substring(c, len(prefix) + 1, 1 << 30)).otherwise(c)


def normalize_entrez(c, species: str) -> Column:
    bare = strip_prefix(F.trim(_col(c)), f"{species}:")
    return F.trim(strip_prefix(bare, "ncbi-geneid:"))


def normalize_id(c, id_type: str, species: str) -> Column:
    """Form of an id used as a join key; a blank stays blank."""
    c = F.trim(_col(c))
    if id_type == "SYMBOL":
        return F.upper(c)
    if id_type in ("ENTREZID", "KEGG"):
        return normalize_entrez(c, species)
    if id_type == "UNIPROT":
        return F.trim(strip_prefix(strip_prefix(c, "uniprot:"), "up:"))
    if id_type in ("ENSEMBL", "REFSEQ"):
        return F.trim(strip_prefix(F.upper(c), f"{id_type}:"))
    return c


def normalize_set_id(c) -> Column:
    """Pathway id without its ``pathway:`` or ``path:`` prefix."""
    return F.regexp_replace(_col(c), r"^(pathway:|path:)", "")


def after_colon(c) -> Column:
    """Everything behind the first colon, or the text itself."""
    return F.regexp_replace(_col(c), r"^[^:]*:", "")


def strip_version(c) -> Column:
    """Accession before its first dot (a dot in front is kept); ``-`` and blank become null."""
    text = clean(c)
    bare = F.when(text.startswith("."), text).otherwise(F.regexp_replace(text, r"\..*\z", ""))
    return F.nullif(bare, F.lit("-"))


def dash_to_null(c) -> Column:
    return F.nullif(clean(c), F.lit("-"))


def parse_double(c) -> Column:
    """Number or null; blank, NA and garbage give null."""
    text = clean(c)
    return F.when(F.upper(text) == "NA", F.lit(None)).otherwise(text).try_cast("double")


def is_placeholder(name, set_id) -> Column:
    """True when a set name says nothing: blank, a dash, or the id itself in any case."""
    name = F.lower(F.trim(F.coalesce(_col(name), F.lit(""))))
    set_id = F.lower(F.trim(_col(set_id)))
    return (
        name.isin("", "-")
        | (name == set_id)
        | (normalize_set_id(name) == normalize_set_id(set_id))
    )


def is_blank_text(c) -> Column:
    """True for a blank or a dash."""
    return F.trim(F.coalesce(_col(c), F.lit(""))).isin("", "-")


def display_name(description, name, set_id) -> Column:
    """Description unless blank or NA, else name, else id."""
    text = F.trim(F.coalesce(_col(description), F.lit("")))
    usable = F.when((text != "") & (F.upper(text) != "NA"), text)
    return F.coalesce(usable, F.nullif(F.trim(_col(name)), F.lit("")), _col(set_id))


def ratio_text(part, whole) -> Column:
    return F.concat_ws("/", _col(part).cast("string"), _col(whole).cast("string"))


def ratio_part(c, index: int) -> Column:
    """Number 0 (before the slash) or 1 (behind it) of a ``k/n`` text."""
    pieces = F.split(_col(c), "/", 2)
    return F.when(F.size(pieces) == 2, F.try_element_at(pieces, F.lit(index + 1)).try_cast("bigint"))
