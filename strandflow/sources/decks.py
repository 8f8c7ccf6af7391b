"""Annotated slide decks: one micrograph per slide with freeform curves over it.

A task unzips a deck and lists its shapes as they stand in the file; placing
paths on the page, turning commands into curves and page units into pixels are
column expressions.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections import Counter
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandflow.operators.curves import BEZIER_SAMPLES, Layout, block_of, flatten_bezier, with_position
from strandflow.operators.tiles import map_rows
from strandflow.session import cut_lineage
from strandflow.sources.images import picture_size
from strandflow.sources.mrc import with_image_id

# XML namespaces of presentation files.
DRAWING = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
SLIDE = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/package/2006/relationships}"
#: Path commands that draw, and how many points each brings.
COMMANDS = {"moveTo": 1, "lnTo": 1, "cubicBezTo": 3}

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
BOX = T.StructType([T.StructField(c, T.DoubleType()) for c in ("left", "top", "width", "height")])
#: A shape as it stands in the file: its box on the page, its path in units of its own grid.
SHAPES = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("slide", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("item", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("box", BOX),
        T.StructField("grid_w", T.DoubleType()),
        T.StructField("grid_h", T.DoubleType()),
        T.StructField("closed", T.BooleanType()),
        T.StructField("commands", T.ArrayType(T.StringType())),
        T.StructField("points", T.ArrayType(POINT)),
        T.StructField("picture", T.BinaryType()),
        T.StructField("pixel_w", T.IntegerType()),
        T.StructField("pixel_h", T.IntegerType()),
    ]
)


class SlideEvents:
    """Collects pictures, freeforms and text boxes from a slide's XML events; the file decides what is in them."""

    def __init__(self) -> None:
        self.shapes: list[dict] = []
        self.open: dict | None = None
        self.pen = ""

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in (f"{SLIDE}pic", f"{SLIDE}sp"):
            self.open = {"kind": "picture" if tag.endswith("pic") else "label", "text": "", "box": {}, "commands": [], "points": [], "closed": False}
            return
        shape, name = self.open, tag.removeprefix(DRAWING)
        if shape is None or name == tag:
            return
        number = lambda key: float(attrs.get(key) or 0)
        if name == "off" and "left" not in shape["box"]:
            shape["box"] |= {"left": number("x"), "top": number("y")}
        elif name == "ext" and "cx" in attrs and "width" not in shape["box"]:
            shape["box"] |= {"width": number("cx"), "height": number("cy")}
        elif name == "custGeom" and shape["kind"] == "label":
            shape["kind"] = "curve"
        elif name == "path" and "grid_w" not in shape:
            shape |= {"grid_w": number("w"), "grid_h": number("h")}
        elif name == "close":
            shape["closed"] = True
        elif name in COMMANDS:
            self.pen = name
            shape["commands"].append(name)
        elif name == "pt" and self.pen:
            shape["points"].append({"x": number("x"), "y": number("y")})

    def data(self, text: str) -> None:
        if self.open is not None:
            self.open["text"] += text

    def end(self, tag: str) -> None:
        if tag.removeprefix(DRAWING) in COMMANDS:
            self.pen = ""
        elif tag in (f"{SLIDE}pic", f"{SLIDE}sp") and self.open is not None:
            self.shapes.append(self.open)
            self.open = None

    def close(self) -> list[dict]:
        return self.shapes


def slide_shapes(z: zipfile.ZipFile, n: int) -> list[dict]:
    """The shapes of slide ``n`` that carry something, numbered by kind."""
    parser = ElementTree.XMLParser(target=SlideEvents())
    parser.feed(z.read(f"ppt/slides/slide{n}.xml"))
    links = ElementTree.fromstring(z.read(f"ppt/slides/_rels/slide{n}.xml.rels")).iter(f"{RELATION}Relationship")
    images = [x.get("Target", "") for x in links if x.get("Type", "").endswith("/image") or "image" in x.get("Type", "")]
    count: Counter = Counter()
    out = []
    for shape in parser.close():
        shape["text"] = shape["text"].strip()
        if shape["kind"] == "label" and not shape["text"]:
            continue
        out.append({**shape, "slide": n, "item": count[shape["kind"]]})
        count[shape["kind"]] += 1
    if count["picture"] != 1 or len(images) != 1:
        raise ValueError(f"slide {n} shows {count['picture']} pictures from {len(images)} image files; one micrograph is needed")
    blob = z.read(posixpath.normpath(posixpath.join("ppt/slides", images[0])))
    width, height = picture_size(blob)
    for shape in out:
        if "left" not in shape["box"] or "width" not in shape["box"]:
            raise ValueError(f"slide {n}: a {shape['kind']} has no place on the page")
        shape |= {"pixel_w": width, "pixel_h": height, "picture": blob if shape["kind"] == "picture" else None}
    return out


def read_deck(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(pictures, traces, labels)`` in pixels of each slide's picture, from a deck or a folder of decks.

    traces: image_id, filament_id, trace_index, seq, n, x, y, block. labels:
    image_id, label_no, label, x, y. image_id is ``<deck>_slideNN``. A closed
    path, a freeform without one, and a slide without one picture are errors.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def decode(row: dict) -> list[dict]:
        with zipfile.ZipFile(io.BytesIO(row["content"])) as z:
            slides = sum(bool(re.fullmatch(r"ppt/slides/slide\d+\.xml", n)) for n in z.namelist())
            shapes = [s for n in range(1, slides + 1) for s in slide_shapes(z, n)]
        for s in shapes:
            if s["kind"] == "curve" and (s["closed"] or not s["commands"]):
                what = "is closed" if s["closed"] else "has no path"
                raise ValueError(f"{row['path']}, slide {s['slide']}: freeform {s['item']} {what}; a trace is an open line")
        return [{"path": row["path"], **s} for s in shapes]

    shapes = with_image_id(cut_lineage(map_rows(files, decode, SHAPES)))
    shapes = shapes.withColumn("image_id", F.format_string("%s_slide%02d", "image_id", "slide"))
    frame = shapes.filter("kind = 'picture'").select("image_id", F.col("box").alias("frame"))
    parts = shapes.filter("kind <> 'picture'").join(frame, "image_id")

    def pixel(p):
        return F.struct(
            ((p["x"] - F.col("frame.left")) / F.col("frame.width") * F.col("pixel_w")).alias("x"),
            ((p["y"] - F.col("frame.top")) / F.col("frame.height") * F.col("pixel_h")).alias("y"),
        )

    def on_page(p):
        """From the units of a path's grid to those of the page."""
        scaled = lambda side, grid: F.when(F.col(grid) > 0, F.col(f"box.{side}") / F.col(grid)).otherwise(0.0)
        return F.struct(
            (F.col("box.left") + p["x"] * scaled("width", "grid_w")).alias("x"),
            (F.col("box.top") + p["y"] * scaled("height", "grid_h")).alias("y"),
        )

    # A command's points follow those of all commands before it; it starts where the last one ended.
    brings = F.transform("commands", lambda c: F.when(c == "cubicBezTo", 3).otherwise(1))
    stepped = parts.filter("kind = 'curve'").withColumn("page", F.transform("points", on_page)).withColumn("brings", brings)
    drawn = stepped.select(
        "*", F.posexplode("commands").alias("step", "command")
    ).withColumn("before", F.aggregate(F.slice("brings", 1, F.col("step")), F.lit(0), lambda a, n: a + n))
    point = lambda k: F.get("page", F.col("before") + k)
    flat = F.when(
        F.col("command") == "cubicBezTo",
        F.slice(flatten_bezier(point(-1), point(0), point(1), point(2)), 2, BEZIER_SAMPLES - 1),
    ).otherwise(F.array(point(0)))
    vertices = drawn.select(
        "image_id",
        F.col("item").alias("trace_index"),
        F.col("step").cast("long").alias("block"),
        F.posexplode(F.transform(flat, pixel)).alias("k", "p"),
    ).select("image_id", "trace_index", "block", "k", "p.x", "p.y")
    pos = with_position(vertices, Layout(keys=("image_id", "trace_index"), order=("k",)))
    traces = pos.select(
        "image_id",
        F.format_string("%s_%02d", "image_id", "trace_index").alias("filament_id"),
        "trace_index",
        F.col("i").alias("seq"),
        "n",
        F.round("x", 3).alias("x"),
        F.round("y", 3).alias("y"),
        block_of(F.col("i")).alias("block"),
    )
    corner = F.struct(F.col("box.left").alias("x"), F.col("box.top").alias("y"))
    labels = parts.filter("kind = 'label'").select(
        "image_id", F.col("item").alias("label_no"), F.col("text").alias("label"), pixel(corner).alias("p")
    ).select("image_id", "label_no", "label", "p.x", "p.y")
    pictures = shapes.filter("kind = 'picture'").select(
        "image_id", F.col("pixel_w").alias("width"), F.col("pixel_h").alias("height"), "picture"
    )
    return pictures, traces, labels
