"""Document structure, matching, counting and resolution operators."""
