"""Planning helpers shared by operators: checkpoints, size-checked joins, components."""
