"""Column-level functions: every one returns a native ``Column`` expression
(no Python UDF), so it stays inside whole-stage codegen."""

from viewlens.functions.scalars import *  # noqa: F401,F403
from viewlens.functions.scalars import __all__  # noqa: F401
