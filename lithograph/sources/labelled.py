"""Labelled raster files made from pixels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_file(cube: np.ndarray, org: str = "BSQ", extra: str = "") -> bytes:
    """bands x lines x samples (i2, i4, u1, f4 or f8) as a labelled raster, big-endian, in the given order."""
    kind = {"u1": "BYTE", "i2": "HALF", "i4": "FULL", "f4": "REAL", "f8": "DOUB"}[cube.dtype.str[1:]]
    bands, lines, width = cube.shape
    order = {"BSQ": (0, 1, 2), "BIL": (1, 0, 2), "BIP": (1, 2, 0)}[org]
    body = np.ascontiguousarray(cube.transpose(order)).astype(cube.dtype.newbyteorder(">")).tobytes()
    record = cube.dtype.itemsize * (bands if org == "BIP" else width)
    text = f"FORMAT='{kind}' TYPE='IMAGE' ORG='{org}' NL={lines} NS={width} NB={bands} RECSIZE={record} NLB=0 NBB=0 EOL=0 INTFMT='HIGH' REALFMT='IEEE' {extra}"
    size = -(-(len(text) + 24) // record) * record
    return f"LBLSIZE={size:<8} {text}".encode("latin-1").ljust(size, b"\0") + body


def encode(pixels: DataFrame, lines: int = 256) -> DataFrame:
    """path (image/strip), content: a 16-bit file for each strip of ``lines`` lines of an image."""

    def write(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        y = rows["y"] - key[1] * lines
        cube = np.zeros((rows["band"].max() + 1, y.max() + 1, rows["x"].max() + 1), np.int16)
        cube[rows["band"], y, rows["x"]] = rows["dn"]
        return pd.DataFrame({"path": [f"{key[0]}/{key[1]}"], "content": [labelled_file(cube, ("BSQ", "BIL", "BIP")[key[1] % 3])]})

    strips = pixels.select("image_id", F.expr(f"y div {lines}").alias("strip"), "y", "x", "band", "dn")
    return strips.groupBy("image_id", "strip").applyInPandas(write, "path string, content binary")
