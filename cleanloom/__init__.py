"""cleanloom: profile, repair and prepare messy tables as Spark jobs."""

from cleanloom.plans.recipe import Recipe, apply_commands, apply_op, apply_recipe, command_ops  # noqa: F401
