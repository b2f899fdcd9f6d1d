"""capledger: capital-structure facts from disclosure documents, as DataFrame plans."""
