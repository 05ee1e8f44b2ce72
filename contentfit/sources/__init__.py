from contentfit.sources.tables import (  # noqa: F401
    DRIVER_TABLES, MissingColumnsError, read_csv, read_search_performance,
    read_table, require_columns, search_performance, table_path, write_table,
)
from contentfit.sources.compat import LAYOUTS, from_reference, to_reference  # noqa: F401,E402
