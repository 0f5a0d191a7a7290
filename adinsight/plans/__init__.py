"""Sample facts over the star-schema tables and the registered queries."""
