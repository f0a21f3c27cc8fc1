"""Projects as XML and as tables: directories, files, images and pages with their references.

Tables: directories (id, path), files (id, dir_id, name), images (id, file_id,
file_image, sub_pages, width, height, dpi_x, dpi_y, grayscale), pages (id,
image_id, sub_page).  Reading keeps rows whose references resolve.
"""

from __future__ import annotations

from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "directory": "_id long, _path string",
    "file": "_id long, _dirId long, _name string",
    "image": "_id long, _subPages int, _fileId long, _fileImage int, size struct<_width: int, _height: int>, dpi struct<_horizontal: int, _vertical: int>, grayscale struct<_value: int>",
    "page": "_id long, _imageId long, _subPage string",
}
SIDES = {"single": 0, "left": 1, "right": 2}


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The four tables of a project file, unresolved."""
    rows = {tag: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path) for tag, schema in SCHEMAS.items()}
    side = F.create_map(*(F.lit(x) for pair in SIDES.items() for x in pair))
    return {
        "directories": rows["directory"].select(F.col("_id").alias("id"), F.col("_path").alias("path")),
        "files": rows["file"].select(F.col("_id").alias("id"), F.col("_dirId").alias("dir_id"), F.col("_name").alias("name")),
        "images": rows["image"].select(
            F.col("_id").alias("id"),
            F.col("_fileId").alias("file_id"),
            F.coalesce("_fileImage", F.lit(0)).alias("file_image"),
            F.col("_subPages").alias("sub_pages"),
            F.col("size._width").alias("width"),
            F.col("size._height").alias("height"),
            F.col("dpi._horizontal").alias("dpi_x"),
            F.col("dpi._vertical").alias("dpi_y"),
            (F.coalesce(F.col("grayscale._value"), F.lit(0)) != 0).alias("grayscale"),
        ),
        "pages": rows["page"].select(F.col("_id").alias("id"), F.col("_imageId").alias("image_id"), F.element_at(side, F.col("_subPage")).alias("sub_page")),
    }


def resolved(tables: dict[str, DataFrame]) -> DataFrame:
    """A row for each page with its image, file and folder; rows whose references lead nowhere, and images of other than one or two pages, are left out."""
    d = tables["directories"].select(F.col("id").alias("dir_id"), F.col("path").alias("dir"))
    f = tables["files"].select(F.col("id").alias("file_id"), "dir_id", "name")
    i = tables["images"].where("sub_pages between 1 and 2").withColumnRenamed("id", "image_id")
    p = tables["pages"].where("sub_page is not null").withColumnRenamed("id", "page_id")
    out = p.join(i, "image_id").join(f, "file_id").join(d, "dir_id")
    return out.select("page_id", "image_id", "sub_page", F.concat_ws("/", "dir", "name").alias("path"), "file_image", "width", "height", "dpi_x", "dpi_y", "grayscale")


def lines(tables: dict[str, DataFrame], folder: str, direction: str = "LTR") -> DataFrame:
    """k, value: the project file's lines in order."""
    q = lambda c: F.concat(F.lit('"'), *[_escaped(F.col(c).cast("string"))], F.lit('"'))
    el = lambda tag, **at: F.concat(F.lit(f"<{tag}"), *(x for name, c in at.items() for x in (F.lit(f" {name}="), q(c))), F.lit("/>"))
    side = F.element_at(F.create_map(*(F.lit(x) for name, k in SIDES.items() for x in (k, name))), F.col("sub_page"))
    image = F.concat(
        F.regexp_replace(el("image", id="id", subPages="sub_pages", fileId="file_id", fileImage="file_image"), "/>$", ">"),
        el("size", width="width", height="height"),
        F.when(F.col("dpi_x").isNotNull() & F.col("dpi_y").isNotNull(), el("dpi", horizontal="dpi_x", vertical="dpi_y")).otherwise(""),
        F.when(F.col("grayscale"), '<grayscale value="1"/>').otherwise(""),
        F.lit("</image>"),
    )
    parts = [
        ("directories", tables["directories"].select("id", el("directory", id="id", path="path").alias("value"))),
        ("files", tables["files"].select("id", el("file", id="id", dirId="dir_id", name="name").alias("value"))),
        ("images", tables["images"].select("id", image.alias("value"))),
        ("pages", tables["pages"].withColumn("side", side).select("id", el("page", id="id", imageId="image_id", subPage="side").alias("value"))),
    ]
    spark = tables["pages"].sparkSession
    head = f"<project outputDirectory={quoteattr(folder)} layoutDirection={quoteattr(direction)}>"
    fixed = [(0, 0, head), (9, 0, "</project>")] + [x for k, (name, _) in enumerate(parts, 1) for x in ((k, -1, f"<{name}>"), (k, 1 << 62, f"</{name}>"))]
    out = spark.createDataFrame(fixed, "part int, id long, value string")
    for k, (_, rows) in enumerate(parts, 1):
        out = out.unionByName(rows.select(F.lit(k).alias("part"), F.col("id").cast("long").alias("id"), "value"))
    return out


def _escaped(c):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def write(tables: dict[str, DataFrame], path: str, folder: str, direction: str = "LTR") -> None:
    """The project file, as one text file in the folder ``path``: a project lists files, not pixels, so its text is small."""
    lines(tables, folder, direction).orderBy("part", "id").select("value").coalesce(1).write.mode("overwrite").text(path)
