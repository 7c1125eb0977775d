"""Readers, writers and model persistence."""

from autotab.sources.models_io import load_model, save_model  # noqa: F401
from autotab.sources.tables import (preview, read_csv, read_feather, read_parquet,  # noqa: F401
                                    read_table, write_csv, write_feather)
