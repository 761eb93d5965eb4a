"""factsheet: Spark-native profiling of tables for supervised learning."""

from factsheet.errors import ProfileRefused
from factsheet.plans.profile import profile_table

__all__ = ["profile_table", "ProfileRefused"]
