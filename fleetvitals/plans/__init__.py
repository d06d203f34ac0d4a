"""Physical-plan helpers: session settings, skew-safe joins, top rows, durable intermediate results."""

from fleetvitals.plans.durable import durable, scratch_path, stored, work_folder
from fleetvitals.plans.first_rows import first_rows
from fleetvitals.plans.numbering import number_any, number_rows, repeat_rows
from fleetvitals.plans.session import tune
from fleetvitals.plans.skew import block_join

__all__ = ["block_join", "durable", "first_rows", "number_any", "number_rows", "repeat_rows", "scratch_path", "stored", "tune", "work_folder"]
