"""Column -> Column expressions."""
from trailcast.functions.text import *  # noqa: F401,F403
from trailcast.functions.naming import *  # noqa: F401,F403
