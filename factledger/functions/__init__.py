"""factledger functions."""
