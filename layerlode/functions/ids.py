"""Short identifiers of topics: layer and cluster in 24 bits, as four characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 10 bits hold cluster + 1, 14 the layer.
MOST_CLUSTER, MOST_LAYER = (1 << 10) - 2, (1 << 14) - 1


def topic_uid(layer: Column, cluster: Column) -> Column:
    """Null where layer or cluster don't fit the identifier."""
    packed = F.shiftleft(layer, 10).bitwiseOR(cluster + 1)
    text = F.translate(F.base64(F.unhex(F.lpad(F.hex(packed), 6, "0"))), "+/", "-_")
    return F.when(layer.between(0, MOST_LAYER) & cluster.between(-1, MOST_CLUSTER), text)


def uid_layer(uid: Column) -> Column:
    return F.shiftright(_packed(uid), 10).cast("int")


def uid_cluster(uid: Column) -> Column:
    return (_packed(uid).bitwiseAND(F.lit((1 << 10) - 1)) - 1).cast("int")


def _packed(uid: Column) -> Column:
    return F.conv(F.hex(F.unbase64(F.translate(uid, "-_", "+/"))), 16, 10).cast("int")
