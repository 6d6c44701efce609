"""Query registry of the core: callables (spark, sf_dir) and the SQL they are checked with."""

from weftgraph.plans import extra, general, graph
from weftgraph.session import shipped

QUERIES = shipped({**general.QUERIES, **graph.Q, **extra.QUERIES})
ORACLE = {**general.ORACLE, **graph.SQL, **extra.ORACLE}
