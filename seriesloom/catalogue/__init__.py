"""Named queries over the shared test tables, each with its SQL counterpart where SQL can say it."""

from seriesloom.catalogue import axis, cleaning, files, flagship, modelling, preparation, profiles, scoring, windows  # noqa: F401
from seriesloom.catalogue.base import QUERIES, SQL  # noqa: F401
