"""Named queries and the mapping of the star-schema test tables onto the incident model."""
