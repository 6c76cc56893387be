"""Records of a network scan as a graph of devices and points."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.template import NETWORK, Template
from ..terms import A, BAD_IRI, iri_col, literal_col, param

# The vocabularies in which devices, points and their references are said.
BRICK = "https://brickschema.org/schema/Brick#"
REFERENCE = "https://brickschema.org/schema/ref#"

_HERE, _REF = param("name"), "_:reference"
DEVICE = Template("device", ((_HERE, A, f"<{NETWORK}BACnetDevice>"), (_HERE, f"<{NETWORK}device-instance>", param("instance")), (_HERE, f"<{NETWORK}hasAddress>", param("address"))))
POINT = Template(
    "point",
    (
        (_HERE, A, f"<{BRICK}Point>"),
        (_HERE, f"<{REFERENCE}hasExternalReference>", _REF),
        (_REF, A, f"<{REFERENCE}BACnetReference>"),
        (_REF, f"<{NETWORK}object-identifier>", param("identifier")),
        (_REF, f"<{NETWORK}object-name>", param("title")),
        (_REF, f"<{NETWORK}objectOf>", param("device")),
    ),
)


def _named(namespace: str, *parts: Column) -> Column:
    """An IRI of these parts; null if one of them is, and characters that no IRI may have become ``_``."""
    return iri_col(F.concat(F.lit(namespace), F.regexp_replace(F.concat(*parts), BAD_IRI, "_")))


def graph(records: DataFrame, namespace: str) -> DataFrame:
    """Devices and the points on them, from (rtype, fields) records of kind Device and Object.

    A device is named by its id, or by its address if the id is empty; a point by its name and address, so points
    of one name and address on several devices are one point with a reference to each.  Other records, points without name, address,
    type or device, and devices without id or address give nothing.

    Each term is made once a record, however many triples say it, and like points are put together before they become triples:
    those about a reference, which stands for all of a point's terms, cannot meet again.
    """
    f = F.col("fields")
    whole = {k: f[k].isNotNull() for k in ("device_id", "address", "name", "type")}
    told = F.when(F.length(f["device_id"]) > 0, f["device_id"]).otherwise(f["address"])
    devices = records.where((F.col("rtype") == "Device") & whole["device_id"] & whole["address"]).select(
        _named(namespace, told).alias("name"), literal_col(f["device_id"]).alias("instance"), literal_col(f["address"]).alias("address")
    )
    points = records.where((F.col("rtype") == "Object") & whole["device_id"] & whole["address"] & whole["name"] & whole["type"]).select(
        _named(namespace, f["name"], F.lit("-"), f["address"]).alias("name"),
        literal_col(F.concat(f["type"], F.lit(","), f["address"])).alias("identifier"),
        literal_col(f["name"]).alias("title"),
        _named(namespace, f["device_id"]).alias("device"),
    )
    have = {p: F.col(p) for p in POINT.parameters}
    points = points.distinct().select("*", POINT.row_key(have).alias("_key"))
    of_reference = replace(POINT, body=tuple(t for t in POINT.body if _REF in t))
    kinds = replace(POINT, body=tuple(t for t in POINT.body if _REF not in t))
    return DEVICE.graph(devices).unionByName(points.select(F.inline(of_reference.triples(have, key=F.col("_key"))))).unionByName(kinds.graph(points.select("name")))
