"""plans of loomline."""
