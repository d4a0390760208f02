"""Product-usage analytics on Spark DataFrames.

    from cohortlens import Params, read_tables, REPORTS, Derived, run_pipeline
    t = read_tables(spark, "s3://bucket/usage")              # user_info/, events/, geography/
    REPORTS["segment_summary"].fn(Derived(t, Params())).show()
    run_pipeline(spark, {"events": t}, "s3://bucket/warehouse", Params(), max_parallel=4)
"""

from .params import DEFAULT, Params
from .runner import run_pipeline
from .sources.tables import Tables, read_catalog_tables, read_parquet_tables, read_tables
from .suite import DERIVED_TABLES, REPORTS, Derived

__all__ = ["DEFAULT", "DERIVED_TABLES", "REPORTS", "Derived", "Params", "Tables", "read_catalog_tables",
           "read_parquet_tables", "read_tables", "run_pipeline"]
