"""Training-data operators: ten document, page and conversation operators plus their
registered queries (``queries``).  Nothing else in the library imports this package."""
