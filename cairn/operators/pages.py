"""Page and layout operators of document conversion, on rows of pages, lines and images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page_class(image_ratio: Column, text_chars: Column) -> Column:
    """scanned: images cover half the page, or a tenth of one with less than ten characters."""
    return F.when((image_ratio >= 0.5) | ((text_chars < 10) & (image_ratio >= 0.1)), "scanned").otherwise("text")


def without_repeating_lines(lines: DataFrame, per: str = "doc_id", least_pages: int = 4, share: float = 0.6, most_chars: int = 80) -> DataFrame:
    """lines (per, page, n, line) without the first and last lines that repeat over a document's pages.

    A document needs least_pages pages with text; a candidate repeats on max(2, share of them) pages or more.
    """
    s = F.trim("line")
    blank = s == ""
    w = Window.partitionBy(per, "page")
    ends = lines.withColumn("_s", s).withColumn("_a", F.min(F.when(~blank, F.col("n"))).over(w)).withColumn("_b", F.max(F.when(~blank, F.col("n"))).over(w))
    edge = (F.col("n") == F.col("_a")) | (F.col("n") == F.col("_b"))
    pages = lines.where(s != "").groupBy(per).agg(F.countDistinct("page").alias("_pages"))
    often = ends.where(edge & (F.length("_s") <= most_chars)).select(per, "page", "_s").distinct().groupBy(per, "_s").agg(F.count("*").alias("_c"))
    banned = often.join(pages, per).where((F.col("_pages") >= least_pages) & (F.col("_c") >= F.greatest(F.lit(2), F.floor(F.lit(share) * F.col("_pages"))))).select(per, "_s", F.lit(True).alias("_banned"))
    return ends.withColumn("_edge", edge).join(banned, [per, "_s"], "left").where(~(F.col("_edge") & F.coalesce("_banned", F.lit(False)))).select(*lines.columns)


def selected_images(images: DataFrame, pages: DataFrame, per: str = "doc_id", least_px: int = 50, share: float = 0.5, cap: int = 50) -> DataFrame:
    """images (per, page, hash, width, height, ordinal) large enough, not repeated over pages, once a page, the first cap."""
    big = images.where((F.col("width") >= least_px) & (F.col("height") >= least_px))
    spread = big.groupBy(per, "hash").agg(F.countDistinct("page").alias("_p")).join(pages, per)
    banned = spread.where(F.col("_p") >= F.greatest(F.lit(2), F.floor(F.lit(share) * F.col("pages")))).select(per, "hash")
    once = big.join(banned, [per, "hash"], "left_anti").withColumn("_n", F.row_number().over(Window.partitionBy(per, "page", "hash").orderBy("ordinal"))).where("_n = 1")
    return once.withColumn("_n", F.row_number().over(Window.partitionBy(per).orderBy("page", "ordinal"))).where(F.col("_n") <= cap).select(*images.columns)


def without_debris(lines: DataFrame, per: list[str], run: int = 3, most_chars: int = 3) -> DataFrame:
    """lines (per, n, line) without runs of very short lines (axis labels) and lines of a page number alone."""
    s = F.trim("line")
    debris = (F.length(s) <= most_chars) & (s != "")
    o = Window.partitionBy(*per).orderBy("n")
    marked = lines.withColumn("_d", debris).withColumn("_g", F.sum((~debris).cast("int")).over(o.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    sized = marked.withColumn("_k", F.sum(F.col("_d").cast("int")).over(Window.partitionBy(*per, "_g")))
    return sized.where(~(F.col("_d") & (F.col("_k") >= run)) & ~s.rlike(r"^\d{1,3}$")).select(*lines.columns)


def heading_level(height: Column, median_height: Column) -> Column:
    """1 to 3 by how much taller a line is than the median, 0 for body text."""
    ratio = F.try_divide(height, median_height)
    return F.when(ratio >= 2.0, 1).when(ratio >= 1.6, 2).when(ratio >= 1.35, 3).otherwise(0)


def median_heights(glyphs: DataFrame, per: list[str]) -> DataFrame:
    return glyphs.groupBy(*per).agg(F.median("height").alias("median_height"), F.median("width").alias("median_width"))


def lines_of(glyphs: DataFrame, per: list[str], gap: float = 0.3) -> DataFrame:
    """Text lines of glyphs (per, ch, x0, y0, x1, y1): same baseline within half the height, a space where a gap is wide."""
    o = Window.partitionBy(*per).orderBy("y0", "x0")
    fresh = (F.lag("y0").over(o).isNull() | (F.abs(F.col("y0") - F.lag("y0").over(o)) > (F.col("y1") - F.col("y0")) / 2)).cast("int")
    lined = glyphs.withColumn("_f", fresh).withColumn("line_no", F.sum("_f").over(o.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    x = Window.partitionBy(*per, "line_no").orderBy("x0")
    wide = F.col("x0") - F.lag("x1").over(x) > gap * (F.col("y1") - F.col("y0"))
    spelled = lined.withColumn("_c", F.when(wide, F.concat(F.lit(" "), F.col("ch"))).otherwise(F.col("ch")))
    return spelled.groupBy(*per, "line_no").agg(F.array_sort(F.collect_list(F.struct("x0", "_c"))).alias("l"), F.max(F.col("y1") - F.col("y0")).alias("height")).select(*per, "line_no", F.array_join("l._c", "").alias("line"), "height")
