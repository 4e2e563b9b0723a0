"""The split map of a hazard: spatial split, erosion, balance, sample."""

from pyspark.sql import DataFrame

from graticule.operators.focal import erode_borders
from graticule.operators.sampling import balance_by_region, sample_n, spatial_split
from graticule.session import durable


def partition_map(cells: DataFrame, height, width, region="rid", label="y", mask=None, kernel=5,
                  n=1_000_000, seed=42) -> DataFrame:
    """(cell, r, c, region, label, split) of the cells that take part.

    Whole regions are split, validation and test cells whose kernel meets another
    split are dropped, each region's negatives are thinned to its positives, and
    ``n`` cells are drawn.  Counting and choosing read their input several times,
    so the eroded and the balanced map are written to the scratch folder between.
    """
    split = spatial_split(cells, region, label, mask, seed)
    eroded = durable(erode_borders(split, "split", kernel, height, width, carry=(region, label)))
    balanced = durable(balance_by_region(eroded, "split", region, label, seed=seed))
    return sample_n(balanced, n, seed=seed)
