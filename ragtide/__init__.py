"""Lazy ragged arrays on Spark: nested lists and records as expressions over DataFrames.

Names are looked up when first used, so that importing a part of the package loads no more than that part.
"""

from __future__ import annotations

from importlib import import_module

_WHERE = {
    "operators.array": "Array Record Scalar ConcretizationTypeError IncompatiblePartitions PartitionCompatibility compatible_partitions partition_compatibility from_dataframe",
    "operators.behavior": "lazy_method lazy_property register",
    "operators.reducers": "all any argmax argmin corr count count_nonzero covar linear_fit max mean min moment prod ptp softmax std sum var",
    "operators.structure": "argcartesian argcombinations argsort broadcast_arrays cartesian combinations copy drop_none enforce_type fill_none firsts flatten from_regular full_like is_none isclose local_index mask nan_to_none nan_to_num num ones_like pad_none ravel run_lengths singletons sort strings_astype to_packed to_regular unflatten unzip values_astype where with_attrs with_field with_name with_parameter without_field without_parameters zeros_like zip",
    "operators.rows": "concatenate map_partitions repartition sample",
    "operators.inspect": "backend fields normalize_single_outer_inner_index type",
    "sources.files": "from_delayed from_json from_lists from_map from_numpy from_parquet from_rows from_text layout_to_jsonschema",
    "sources.sinks": "to_bag to_dataframe to_delayed to_json to_list to_numpy to_parquet",
    "plans.columns": "necessary_columns optimize_columns report_necessary_buffers report_necessary_columns",
    "streaming.rowwise": "from_stream read_parquet_stream write_stream",
    "config": "config settings",
}
_MODULE = {name: where for where, names in _WHERE.items() for name in names.split()}
__all__ = [*_MODULE, "str", "ufuncs"]


def __getattr__(name: str):
    if name in ("str", "ufuncs"):
        return import_module(f"ragtide.functions.{name}")
    if name not in _MODULE:
        raise AttributeError(f"module 'ragtide' has no attribute {name!r}")
    return getattr(import_module(f"ragtide.{_MODULE[name]}"), name)
