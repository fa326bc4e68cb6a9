"""Operators for large training-text corpora; nothing else in the library imports this subpackage."""

import pyarrow

# freed batches go back to the system at once; the default pool keeps them in every Python worker
pyarrow.set_memory_pool(pyarrow.system_memory_pool())
