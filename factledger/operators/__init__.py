"""factledger operators."""
