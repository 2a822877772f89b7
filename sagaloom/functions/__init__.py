"""Part of sagaloom; see the README."""
