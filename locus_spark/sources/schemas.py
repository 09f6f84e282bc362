"""Column lists of the formats, as Spark schemas. Fixed values, in file order."""

from __future__ import annotations

from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

_LONG, _DOUBLE = set("st ed tst ted motif annotated ureads mreads maxoverhang txst txed cdsst cdsed #exons bin score strand2 size map_id mapq".split()), {"value", "ucnt", "mcnt", "tcov"}


def schema(names: str) -> StructType:
    """Columns by name; positions and counts are numbers, the rest text."""
    kinds = {n: LongType() if n in _LONG else DoubleType() if n in _DOUBLE else StringType() for n in names.split()}
    return StructType([StructField(n, k) for n, k in kinds.items()])


BED = "chr st ed name sc1 strand tst ted sc2 #exons esizes estarts"
GTF = "chr src typ st ed sc1 strand sc2 extra"
GFF = "chr src typ st ed sc1 strand sc2 attr"
SJ = "chr st ed name ucnt strand mcnt"
SJTAB = "chr st ed strand2 motif annotated ureads mreads maxoverhang"
READS = "chr st ed read_id mapq strand map_id"
KNOWN_GENE = "name chr strand txst txed cdsst cdsed #exons exst exed proteinid alignid"
REF_GENE = "bin name chr strand txst txed cdsst cdsed #exons exst exed score name2 cdsstat cdsedstat exframes"
CHOPPED = "chr st ed name id"
BEDGRAPH = "chr st ed value"
SIZES = "chr size"
GAF = "db dbid symbol qualifier goid ref evidence withfrom aspect name synonym type taxon date assignedby extension product"

#: Junction strands and splice motifs by their codes.
STRANDS = ((0, "."), (1, "+"), (2, "-"))
MOTIFS = ((0, "non-canonical"), (1, "GT/AG"), (2, "CT/AC"), (3, "GC/AG"), (4, "CT/GC"), (5, "AT/AC"), (6, "GT/AT"))
