"""Sources: source trees, git histories, manifests and parsers."""

from .git import GitSource
from .tree import TreeSource


def register(spark) -> None:
    """Make ``spark.read.format("repotree")`` and ``format("gitlog")`` available."""
    spark.dataSource.register(TreeSource)
    spark.dataSource.register(GitSource)
