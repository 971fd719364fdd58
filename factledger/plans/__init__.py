"""factledger plans."""
