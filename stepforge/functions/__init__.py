"""stepforge subpackage."""
