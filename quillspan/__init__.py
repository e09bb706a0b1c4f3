"""A PySpark-native fact store and rule engine for script projects, with operators for training-data pipelines."""

from quillspan.operators.facts import facts, manifests, with_projects, written
from quillspan.operators.incremental import changed_files, scan_incremental
from quillspan.plans.inspect import inspect
from quillspan.plans.rules import check, diff, impact, project_map
from quillspan.sources.tables import source_files

__all__ = ["changed_files", "check", "diff", "facts", "impact", "inspect", "manifests", "project_map", "scan_incremental", "source_files", "with_projects", "written"]
